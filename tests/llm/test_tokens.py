"""Token ids, packing and token files against the tokenizer used plainly."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinefuse.llm import packing, token_files, tokens
from kinefuse.llm.tokens import default_tokenizer, encoder
from kinefuse.storage import new_path

from .conftest import ROWS


def plain(texts):
    """The library by itself, nothing set."""
    tokenizer = Tokenizer.from_file(default_tokenizer())
    return [x.ids + [0] for x in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("most", [tokens.PIECES, 500])
def test_pieces_give_the_ids_of_whole_texts(monkeypatch, most):
    monkeypatch.setattr(tokens, "PIECES", most)
    rng = random.Random(3)
    letters = list("ab  \n\t.,'|!sé1́ \x1c\x00 ​$")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(25))) for _ in range(4000)] + [t or "" for _, t in ROWS]
    texts += ["it's don't 'll x", "<|endoftext|> a", "x.\n\ny z", " a", "a ", "\n", "a\n b", "AB!!\ncd"]
    white = list("ab.,  \t\n\r\x0b\x0c\x85\xa0\u2003\u2028\u3000")
    texts += ["".join(rng.choice(white) for _ in range(rng.randrange(12))) for _ in range(6000)]
    texts += ["One word.  Two\r\n\r\nthree\t\tfour!\n\n\n", "a <|endoftext|> b", "<|endoftext|>", "x\n<|endoftext|>  y <|endoftext|"]
    own = tokens.PieceEncoder(default_tokenizer())
    wanted = plain(texts)
    for start in range(0, len(texts), 700):
        ids, begins = own.texts(pa.array(texts[start : start + 700], pa.string()))
        for k, want in enumerate(wanted[start : start + 700]):
            assert ids[begins[k] : begins[k + 1]].tolist() == want, repr(texts[start + k])
    assert 50256 in wanted[-3] and encoder(default_tokenizer()) is encoder(default_tokenizer())


def test_pieces_after_a_space_need_no_marks():
    own = tokens.PieceEncoder(default_tokenizer())
    handed, plainly = [], own.raw
    own.raw = lambda texts: handed.extend(texts) or plainly(texts)
    texts = ["one alpha beta's gamma1 ,x é", "one alpha delta beta's", " é alpha"] * 3
    ids, begins = own.texts(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(begins[:-1], begins[1:], strict=True)] == plain(texts)
    # Each distinct piece once; a line break only after the one that does not start with a space.
    assert sum(map(len, handed)) == len("".join([" alpha", " beta's", " gamma1", " ,x", " é", " delta", "one", "\n"]))


def test_a_special_token_with_a_space(tmp_path):
    path = str(tmp_path / "special.json")
    tokenizer = Tokenizer.from_file(default_tokenizer())
    tokenizer.add_special_tokens(["<|a b|>"])
    tokenizer.save(path)
    texts = ["x <|a", "y b|>", "x <|a b|> y", "x <|a c b|>"]
    ids, begins = tokens.PieceEncoder(path).texts(pa.array(texts))
    want = [x.ids + [0] for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(begins[:-1], begins[1:], strict=True)] == want


def test_packing_cuts_the_stream(spark, docs):
    for window in (16, 1024):
        pieces = packing.pack_documents(docs, window).collect()
        by_sequence = {}
        for p in pieces:
            by_sequence.setdefault(p.sequence_id, []).append(p)
        assert sorted(by_sequence) == list(range(len(by_sequence)))
        found = []
        for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
            if p.start == 0:
                found.append((p.doc_id, []))
            assert found[-1][0] == p.doc_id and len(found[-1][1]) == p.start
            found[-1][1].extend(np.frombuffer(p.ids, "<u4").tolist())
        want = sorted(str((i, ids)) for (i, _), ids in zip(ROWS, plain([t for _, t in ROWS]), strict=True))
        assert sorted(map(str, found)) == want
    sequences = packing.packed_sequences(packing.pack_documents(docs, 16)).collect()
    assert all(len(s.ids) == 4 * sum(p.length for p in s.pieces) for s in sequences)


def test_packing_of_nothing(none):
    assert packing.pack_documents(none).count() == 0


def test_token_files(spark, docs):
    path = new_path(spark, "test-token-files")
    token_files.write_token_files(docs, path)
    rows = token_files.read_token_files(spark, path)
    placed = token_files.with_start(rows, rows).collect()
    assert sorted(str((r.doc_id, r.ids)) for r in placed) == sorted(str((i, ids)) for (i, _), ids in zip(ROWS, plain([t for _, t in ROWS]), strict=True))
    ordered = sorted(placed, key=lambda r: r.start)
    assert [r.start for r in ordered] == [sum(q.n_tokens for q in ordered[:k]) for k in range(len(ordered))]
    assert [r.doc_id or 0 for r in ordered] == sorted(r.doc_id or 0 for r in ordered)
    some = token_files.read_token_files(spark, path, F.col("doc_id").isin(5, 9))
    assert some.count() == 3 and "PushedFilters: [In(doc_id" in some._jdf.queryExecution().executedPlan().toString()


def test_token_files_of_nothing(spark, none):
    path = new_path(spark, "test-token-files")
    token_files.write_token_files(none, path)
    rows = token_files.read_token_files(spark, path)
    assert token_files.with_start(rows, rows).count() == 0
