"""Main text of web pages by deducing each host's template.

Tokens of a page are its tags with their place in the tree, and its whole text nodes. The tokens of a host that occur equally often on each of its pages have the same occurrence
vector and form an equivalence class; vectors are compared by a sum of hashes over pages, so no
vector, page list or host is ever gathered. Classes on most of a host's pages with enough tokens are
valid. Put in page order and nested in each other they make the host's template, and what a page has
between the template's tokens are its slots.

Which slots are the main text is read from the host's pages together. An element that each of them opens once
holds some share of the text that is no link; the smallest one with most of it, and with more than one block, is the
host's box, and the slots in it are taken, on pages with a short text too. Tokens repeated in the box are
template only as far as they are its smaller part; a page that mostly repeats others keeps its box whole.

Names only settle what the template cannot. On a host with one page, or without a box, the slots of a marked article are taken
if they hold at least as much text as those outside, else all are. Menus, adverts, comments and the like are left out
by their elements and by whole class names, inside the box as well.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinefuse.llm.queries import llm_query, table
from kinefuse.llm.shipping import ship
from kinefuse.llm.words import M1, mix, runs
from kinefuse.storage import write_and_read

#: A class is valid on at least this share of a host's pages (in hundredths), two at least, with at least this many tokens.
LEAST_PAGES, LEAST_TOKENS = 60, 3
#: Share of a host's text outside of links, in hundredths, that its box holds at least.
BOX_SHARE = 75
#: Letters of a path in a page's tree, beyond which a digest stands for it.
PATH_CHARS = 400

# Elements and names of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
LEFT_OUT = frozenset(
    "head script style noscript noembed noframes template nav footer aside form button select textarea iframe svg canvas object audio video dialog menu title".split()
)
#: What these elements hold is not shown as text.
NOT_SHOWN = RAW | frozenset("head template svg canvas object".split())
LEFT_OUT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices comment comments reply replies "
    "sidebar menu nav navigation navbar breadcrumb breadcrumbs share sharing social related newsletter subscribe popup modal footer header masthead hidden".split()
)
#: Elements that class names never leave out, and names that leave out nothing in an article.
KEPT = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
KEPT_NAMES = frozenset("header masthead".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table article section div body main td th blockquote".split())

_MARK = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'").lower() for m in _ATTRIBUTE.finditer(text)} if text else {}


@dataclass(frozen=True)
class Node:
    """A text node: its token (-1: none), block, innermost element's token (-1: none), and what is known of it by names and marks."""

    place: int
    block: int
    owner: int
    left_out: bool
    inside: bool
    linked: bool
    shown: bool
    text: str


@dataclass(frozen=True)
class Element:
    name: str
    path: str
    token: int
    left_out: bool
    inside: bool
    linked: bool
    shown: bool


class Page:
    """A page read once: its tokens for the template, the elements they lie in, and its text nodes."""

    def __init__(self, source: str, names: bool = True):
        """names: whether names of elements and classes, and article marks, count."""
        self.tokens: list[str] = []
        #: Of each token that opens an element, the token of the element around it.
        self.around: dict[int, int] = {}
        self.nodes: list[Node] = []
        self._names = names
        self._open = [Element("", "", -1, False, False, False, True)]
        self._block = 0
        self._read(source)

    def _read(self, source: str) -> None:
        at, raw = 0, None
        while True:
            if raw:
                stop = re.compile(rf"</{re.escape(raw)}(?=[\s/>])", re.I).search(source, at)
                end = stop.start() if stop else len(source)
                self._text(source[at:end])
                at, raw = end, None
            mark = _MARK.search(source, at)
            if not mark:
                self._text(source[at:])
                return
            if mark.start() > at:
                self._text(source[at : mark.start()])
            at = mark.end()
            if mark[2]:
                name = mark[2].lower()
                if mark[1]:
                    self._end(name)
                else:
                    self._start(name, mark[3])
                    if name in RAW:
                        raw = name

    def _node(self, place: int, text: str) -> Node:
        top = self._open[-1]
        return Node(place, self._block, top.token, top.left_out, top.inside, top.linked, top.shown, text)

    def _text(self, text: str) -> None:
        if not text or text.isspace():
            if text and self.nodes and not self.nodes[-1].text.endswith(" "):
                self.nodes.append(self._node(-1, " "))
            return
        self.nodes.append(self._node(len(self.tokens), text))
        self.tokens.append(f"{self._open[-1].path}={' '.join(text.split())}")

    def _start(self, name: str, rest: str) -> None:
        if name in BLOCK:
            self._block += 1
            if name != "body" and name != "html":
                self._close_upto("p")
        elif name == "br":
            self.nodes.append(self._node(-1, " "))
        for other in CLOSED_BY.get(name, ()):
            self._close_upto(other)
        attributes = _attributes(rest)
        top = self._open[-1]
        left_out, inside = top.left_out, top.inside
        if self._names:
            names = set() if name in KEPT else {*attributes.get("class", "").split(), *attributes.get("id", "").split()} & LEFT_OUT_NAMES
            left_out = (
                left_out
                or name in LEFT_OUT
                or (name == "header" and not inside)
                or bool(names - KEPT_NAMES if inside else names)
                or attributes.get("role") in LEFT_OUT_ROLES
                or "hidden" in attributes
                or attributes.get("aria-hidden") == "true"
            )
            inside = inside or name in ("article", "main") or attributes.get("role") == "main"
        path = f"{top.path}/{name}.{attributes.get('class', '')}"
        if len(path) > PATH_CHARS:
            path = hashlib.md5(path.encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest()
        self.around[len(self.tokens)] = top.token
        if name not in VOID:
            self._open.append(Element(name, path, len(self.tokens), left_out, inside, top.linked or name == "a", top.shown and name not in NOT_SHOWN))
        self.tokens.append(path)

    def _end(self, name: str) -> None:
        if name in BLOCK:
            self._block += 1
        for k in range(len(self._open) - 1, 0, -1):
            if self._open[k].name == name:
                del self._open[k:]
                self.tokens.append(f"{self._open[-1].path}/{name}/")
                return

    def _close_upto(self, name: str) -> None:
        """Close the innermost open element of this name unless a scope stands between."""
        for k in range(len(self._open) - 1, 0, -1):
            if self._open[k].name == name:
                del self._open[k:]
                return
            if self._open[k].name in SCOPE:
                return

    def masses(self) -> dict[int, list[int]]:
        """Of each element, by its token, the letters of text in it that are shown and no link, and the blocks that hold them."""
        found: dict[int, list[int]] = {}
        seen: set[tuple[int, int]] = set()
        for node in self.nodes:
            if node.place < 0 or not node.shown or node.linked:
                continue
            size, owner = len(node.text.strip()), node.owner
            while owner >= 0:
                mass = found.setdefault(owner, [0, 0])
                mass[0] += size
                if (owner, node.block) not in seen:
                    seen.add((owner, node.block))
                    mass[1] += 1
                owner = self.around[owner]
        return found

    def _in_box(self, hashes: list[int], box: int | None) -> dict[int, bool]:
        """Of each element whether it is the box or lies in it."""
        inside = {-1: False}
        for token in sorted(self.around):
            inside[token] = inside[self.around[token]] or (box is not None and hashes[token] == box)
        return inside

    def text(self, template: dict[int, float], box: int | None = None) -> str:
        """Text of the slots. template: hashes of the template's tokens and their mean places; box: hash of the element that holds the main text."""
        hashes = token_hashes(self.tokens).view(np.int64).tolist()
        fixed = [False] * len(self.tokens)
        if template:
            last, seen = -1.0, set()
            for k, token in enumerate(hashes):
                place = template.get(token)
                if place is not None and (place >= last or token in seen):
                    fixed[k], last = True, max(last, place)
                    seen.add(token)
        boxed = self._in_box(hashes, box)
        shown = [n for n in self.nodes if n.shown and not n.left_out]
        held = any(n.place >= 0 and boxed[n.owner] for n in shown)
        main = (lambda n: boxed[n.owner]) if held else (lambda n: n.inside)
        # Text in the box or article and outside, in slots and in the template.
        sizes = {(inside, repeated): 0 for inside in (False, True) for repeated in (False, True)}
        for n in shown:
            if n.place >= 0:
                sizes[main(n), fixed[n.place]] += len(n.text.strip())
        whole = sizes[True, True] > sizes[True, False]
        article = sizes[True, False] + (sizes[True, True] if whole else 0)
        outside = not held and article < sizes[False, False]
        blocks: dict[int, list[str]] = {}
        for n in shown:
            repeated = n.place >= 0 and fixed[n.place]
            if (whole or not repeated) if main(n) else ((outside or not article) and not repeated):
                blocks.setdefault(n.block, []).append(n.text)
        joined = (" ".join(html.unescape("".join(x)).split()) for x in blocks.values())
        return "\n\n".join(x for x in joined if x)


def token_hashes(tokens: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(tokens, object), categorize=False) if tokens else np.empty(0, np.uint64)


TOKENS = "host string, token long, pages long, vector_1 long, vector_2 long, place double, opened long, letters long, blocks long, box boolean"


def _page_tokens(names_count: bool):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each token of a host with what its occurrences in one run of pages add to its vector, and to what it holds if it opens an element."""
        for rows in runs(batches, "html"):
            sums: dict[tuple[str, int], list] = {}
            for host, key, source in zip(rows.column("host").to_pylist(), rows.column("key").to_pylist(), rows.column("html").to_pylist(), strict=True):
                page = Page(source, names_count)
                places: dict[str, int] = {}
                masses: dict[str, list[int]] = {}
                found = page.masses()
                for k, token in enumerate(page.tokens):
                    places.setdefault(token, k)
                    if k in page.around:
                        mass = masses.setdefault(token, [0, 0, 0])
                        mass[0] += 1
                        if k in found:
                            mass[1] += found[k][0]
                            mass[2] += found[k][1]
                counts = Counter(page.tokens)
                names = list(counts)
                hashes = token_hashes(names)
                occurred = mix(np.fromiter(counts.values(), np.uint64, len(names)) + mix(np.array([key], np.int64).view(np.uint64)))
                second = mix(occurred * M1)
                for token, name, one, two in zip(hashes.view(np.int64).tolist(), names, occurred.tolist(), second.tolist(), strict=True):
                    total = sums.setdefault((host, token), [0, 0, 0, 0.0, 0, 0, 0, name in masses])
                    for k, value in enumerate((1, one, two, places[name] / max(len(page.tokens), 1), *masses.get(name, (0, 0, 0)))):
                        total[k] += value
            signed = lambda x: (x + 2**63) % 2**64 - 2**63
            values = list(zip(*sums.values(), strict=True)) or [()] * 8
            columns = {"host": pa.array([k[0] for k in sums], pa.string()), "token": pa.array([k[1] for k in sums], pa.int64()), "pages": pa.array(values[0], pa.int64())}
            columns |= {n: pa.array([signed(v) for v in values[k]], pa.int64()) for k, n in ((1, "vector_1"), (2, "vector_2"))}
            columns |= {"place": pa.array(values[3], pa.float64())}
            columns |= {n: pa.array(values[k], pa.int64()) for k, n in ((4, "opened"), (5, "letters"), (6, "blocks"))}
            yield pa.RecordBatch.from_pydict(columns | {"box": pa.array(values[7], pa.bool_())})

    return emit


def _keyed(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(pages["url"], F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    page = F.coalesce(pages["html"], F.lit(""))
    return pages.select(pages["page_id"].alias("page_id"), pages["url"].alias("url"), page.alias("html"), host.alias("host"), F.xxhash64(pages["page_id"], pages["url"]).alias("key"))


def templates(pages: DataFrame, names: bool = True) -> DataFrame:
    """host, template (array of token, place: the valid classes of each host, in page order), box (token of the element with the main text, null if none).

    No larger for a host than a page or two.
    """
    ship(pages.sparkSession)
    keyed = _keyed(pages)
    tokens = keyed.select("host", "key", "html").mapInArrow(_page_tokens(names), TOKENS)
    sums = (F.sum(n).alias(n) for n in ("pages", "place", "opened", "letters", "blocks"))
    summed = tokens.groupBy("host", "token").agg(*(F.sum(F.col(n).cast("decimal(38,0)")).alias(n) for n in ("vector_1", "vector_2")), *sums, F.max("box").alias("box"))
    wrapped = [(F.pmod(F.col(n), F.lit(str(2**64)).cast("decimal(38,0)"))).alias(n) for n in ("vector_1", "vector_2")]
    summed = summed.select("host", "token", *wrapped, "pages", (F.col("place") / F.col("pages")).alias("place"), "opened", "letters", "blocks", "box")
    sizes = keyed.groupBy("host").agg(F.count("*").alias("_of"))
    common = write_and_read(summed.join(sizes, "host").where(f"pages >= 2 and 100 * pages >= {LEAST_PAGES} * _of"), "host-tokens")
    classes = common.groupBy("host", "vector_1", "vector_2").agg(F.collect_list(F.struct("place", "token")).alias("_tokens")).where(F.size("_tokens") >= LEAST_TOKENS)
    found = classes.groupBy("host").agg(F.sort_array(F.flatten(F.collect_list("_tokens"))).alias("template"))
    # Opened once by each page that has it, and holding more than a block on the average.
    once = common.where("box AND opened = pages AND blocks > pages")
    most = once.groupBy("host").agg(F.max("letters").alias("_most"))
    held = once.join(most, "host").where(f"letters > 0 AND 100 * letters >= {BOX_SHARE} * _most")
    boxes = held.groupBy("host").agg(F.min(F.struct("letters", (-F.col("place")).alias("place"), "token"))["token"].alias("box"))
    return found.join(boxes, "host", "full")


def _extract(names: bool):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, "html"):
            known: dict[str, dict[int, float]] = {}
            texts = []
            for host, source, box, template in zip(*(rows.column(n).to_pylist() for n in ("host", "html", "box")), rows.column("template"), strict=True):
                if host not in known:
                    known[host] = {x["token"]: x["place"] for x in template.as_py() or ()}
                texts.append(Page(source, names).text(known[host], box))
            yield pa.RecordBatch.from_arrays(
                [rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return emit


def main_texts(pages: DataFrame, names: bool = True) -> DataFrame:
    """page_id, url, text, n_chars of every page; a null html or one without article text has an empty text.

    A null url belongs to the host "". Repeated rows count as pages of their own and get the same text. Other columns are left out.
    With names=False the template decides alone: article marks, left-out elements and class names count for nothing.
    """
    found = write_and_read(templates(pages, names), "templates")
    rows = _keyed(pages).join(found, "host", "left").select("page_id", "url", "html", "host", "template", "box")
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(_extract(names), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


@llm_query()
def op3_html_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return main_texts(table(spark, folder, "pages"))
