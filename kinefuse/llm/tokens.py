"""Token ids of whole texts, by the tokenizers library.

A byte-level BPE tokenizer first cuts a text into words and never merges across a cut. It always cuts before
white space, and in a run of white space before its last character, unless the text ends there; it cuts behind white
space other than a space, and between a letter and punctuation that ends the word. Texts are encoded in these
pieces, whatever their white space, and every distinct piece needs the tokenizer only once. Unknown pieces go
through the tokenizer many at a time: those that start with a space just one after the other, as the ids show where
each begins, and others with a line break between each two. Texts with control characters, or with a special token
of the vocabulary in them, are encoded as they stand. Each worker process keeps the ids of the pieces it has met
lately, up to PIECES of them.
"""

from __future__ import annotations

import gc
import os
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark import TaskContext

END_ID = 0
#: Most pieces that a worker process remembers, some 250 bytes each.
PIECES = 400_000
#: Unknown pieces in one text for the tokenizer, and texts that it takes at once.
JOINED, BATCH = 256, 16
#: Texts are encoded in runs of about this many bytes, which bounds a task's memory.
RUN_BYTES = 6_000_000

# White space as the tokenizer's pattern knows it, with and without the plain space.
_OTHER_WHITE = r"\t\n\x0b\x0c\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WHITE = r"\x20" + _OTHER_WHITE
# Characters that are white space to some readers and not to others, and the marks below.
_ODD = r"[\x00-\x08\x0e-\x1f\x7f\x{180e}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{feff}]"
# White space other than single spaces and single line breaks.
_UNEVEN = rf"[{_WHITE}][{_WHITE}]|[\t\x0b-\r\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]"
_WORD_END = r"([A-Za-zÀ-ÖØ-öø-ɏ])([.,!|$%&*#]+[\x00\n])"
# Marks that no text in pieces holds: a cut, a text's end, a text encoded whole.
_CUT, _END, _WHOLE = "\x00", "\x01", "\x02"
# What byte-level vocabularies write for the byte of a space.
_SPACE = "Ġ"
_encoders: dict[str, "PieceEncoder"] = {}


def default_tokenizer() -> str:
    """Path of the public byte-level BPE vocabulary, the same on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> "PieceEncoder":
    """This process's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


class PieceEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = sorted(x.content for x in self.tokenizer.get_added_tokens_decoder().values())
        (self.break_id,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)  # ids whose bytes start with a space
        self.spaced[[number for token, number in vocabulary.items() if token.startswith(_SPACE)]] = True
        # Pieces that start with a space need nothing between them, unless a special token could arise where they meet.
        self.between = "\n" if any(" " in x for x in self.special) or not self.spaced.any() else ""
        self._forget()

    def _forget(self) -> None:
        """Known pieces by number; number k has the ids pool[starts[k] : starts[k + 1]]."""
        self.known: dict[str, int] = {"": 0, _END: 1}
        self.pool, self.starts = np.array([END_ID], "<u4"), np.array([0, 0, 1])

    def raw(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; a few at a time, as the library's results take far more memory than ids."""
        ids: list[np.ndarray] = []
        for start in range(0, len(texts), BATCH):
            found = self.tokenizer.encode_batch_fast(texts[start : start + BATCH], add_special_tokens=False)
            ids += [np.array(x.ids, "<u4") for x in found]
        return ids

    def _joined(self, pieces: list[str], mark: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that do not end in white space, one after the other, and the number of ids of each.

        Line breaks between the pieces are words of their own. With no mark, each piece starts with a space, its
        only one, so it starts where an id does that holds a space.
        """
        if not pieces:
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        ids = np.concatenate(self.raw([mark.join([*pieces[k : k + JOINED], ""]) for k in range(0, len(pieces), JOINED)]))
        cuts = ids == self.break_id if mark else self.spaced[ids]
        at = np.flatnonzero(cuts)
        if len(at) != len(pieces):
            raise ValueError("the vocabulary does not keep line breaks and spaces apart")
        return (ids[~cuts], np.diff(at, prepend=-1) - 1) if mark else (ids, np.diff(at, append=len(ids)))

    def _learn(self, pieces: list[str]) -> np.ndarray:
        """Numbers of distinct pieces that were not known."""
        # 0: starts with a space, 1: does not, 2: ends in white space
        kinds = np.fromiter((2 if p[-1].isspace() else p[0] != " " for p in pieces), np.int8, len(pieces))
        order = np.argsort(kinds, kind="stable")
        led, plain, white = np.split(order, np.cumsum(np.bincount(kinds, minlength=3))[:2])
        self._add(*self._joined([pieces[k] for k in led.tolist()], self.between))
        self._add(*self._joined([pieces[k] for k in plain.tolist()], "\n"))
        single = self.raw([pieces[k] for k in white.tolist()])
        self._add(np.concatenate([np.empty(0, "<u4"), *single]), np.fromiter(map(len, single), np.int64, len(single)))
        numbers = np.empty(len(pieces), np.int64)
        numbers[order] = np.arange(len(pieces)) + len(self.starts) - 1 - len(pieces)
        self.known.update(zip(pieces, numbers.tolist(), strict=True))
        return numbers

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.pool = np.concatenate([self.pool, ids])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])

    def _marked(self, texts: pa.Array) -> pa.Array:
        """Texts with a mark at each cut, and at their ends."""
        uneven = pc.match_substring_regex(texts, _UNEVEN)
        even = pc.replace_substring(texts, " ", f"{_CUT} ")
        end = pa.scalar(_END, texts.type)
        even = pc.replace_substring_regex(pc.binary_join_element_wise(even, end, pa.scalar(_CUT, texts.type)), _WORD_END, rf"\1{_CUT}\2")
        even = pc.replace_substring(even, "\n", f"{_CUT}\n{_CUT}")
        if not pc.any(uneven).as_py():
            return even
        cut = pc.replace_substring_regex(texts.filter(uneven), rf"([{_WHITE}]+)", rf"{_CUT}\1")
        cut = pc.replace_substring_regex(cut, rf"([{_WHITE}]+)([{_WHITE}])([^{_WHITE}\x00])", rf"\1{_CUT}\2\3")
        cut = pc.replace_substring_regex(cut, rf"([{_OTHER_WHITE}])([^{_WHITE}\x00])", rf"\1{_CUT}\2")
        cut = pc.replace_substring_regex(pc.binary_join_element_wise(cut, end, pa.scalar(_CUT, texts.type)), _WORD_END, rf"\1{_CUT}\2")
        return pc.replace_with_mask(even, uneven, cut)

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, each text ended by END_ID, and where each text begins (one more entry than texts)."""
        if len(texts) == 0:
            return np.empty(0, "<u4"), np.zeros(1, np.int64)
        odd = pc.match_substring_regex(texts, _ODD)
        for token in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        kept = [texts[k].as_py() for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()]
        if kept:
            texts = pc.replace_with_mask(texts, odd, pa.array([f"{_WHOLE}{k}" for k in range(len(kept))], texts.type))
        lists = pc.split_pattern(self._marked(texts), _CUT)
        at = lists.offsets.to_numpy().astype(np.int64)
        at -= at[0]
        coded = lists.flatten().dictionary_encode()
        index, names = coded.indices, coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        del lists, coded
        if len(self.known) > PIECES:
            self._remember(names)
        number = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        unknown = np.flatnonzero(number < 0).tolist()
        whole = [k for k in unknown if names[k][0] == _WHOLE] if kept else []
        pieces = [k for k in unknown if names[k][0] != _WHOLE] if kept else unknown
        number[pieces] = self._learn([names[k] for k in pieces])
        first = len(self.starts) - 1
        if kept:
            ids = self.raw(kept)
            self._add(np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids)))
            number[whole] = [first + int(names[k][1:]) for k in whole]
        ids, stops = self._ids(number)
        if kept:
            # Whole texts are not pieces that come again.
            self.pool, self.starts = self.pool[: self.starts[first]], self.starts[: first + 1]
        # The ids of each distinct piece as one value of bytes: Arrow puts them in the order of the texts.
        ends = np.append(0, stops * 4)
        values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(names), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
        _, places, data = values.take(index).buffers()
        places = np.frombuffer(places, np.int64, at[-1] + 1)[at] // 4
        return np.frombuffer(data, "<u4", places[-1]), places

    def _ids(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces of these numbers one after the other, and where each piece's ids end."""
        begin = self.starts[number]
        sizes = self.starts[number + 1] - begin
        stops = np.cumsum(sizes)
        return self.pool[np.repeat(begin - (stops - sizes), sizes) + np.arange(sizes.sum())], stops

    def _remember(self, names: list[str]) -> None:
        """Forgets all pieces but those that are needed now."""
        held = [n for n in names if self.known.get(n, 0) > 1]
        ids, stops = self._ids(np.array([self.known[n] for n in held], np.int64))
        self._forget()
        self._add(ids, np.diff(stops, prepend=0))
        self.known.update(zip(held, range(2, 2 + len(held)), strict=True))


def encoded_runs(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with their ids and where each row's ids begin; null texts count as empty. Column `text` holds the texts."""
    encode = encoder(path)
    for batch in batches:
        texts = pc.fill_null(batch.column("text"), "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + RUN_BYTES))
            stop = min(batch.num_rows, max(stop, start + 1))
            run = texts.slice(start, stop - start)
            if isinstance(run, pa.ChunkedArray):
                run = run.combine_chunks()
            gc.disable()  # many small live objects: collections would find nothing and cost half the time
            try:
                ids, begins = encode.texts(run)
            finally:
                gc.enable()
                pa.default_memory_pool().release_unused()
            yield batch.slice(start, stop - start), ids, begins
            start = stop


def task_number() -> int:
    """Number of the partition that this task makes; the same again when the task is repeated."""
    context = TaskContext.get()
    return context.partitionId() if context else 0
