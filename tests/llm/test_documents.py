"""Quality rules and classifier, chat format, pages and archives, the queries' SQL, the pipeline."""

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinefuse.llm import chat_format, html_text, quality_rules, rule_ensemble, warc
from kinefuse.llm.queries import load
from kinefuse.storage import new_path
from oracle import compare, connect

from .conftest import DOCS, ROWS, rows

FOLDER = os.environ.get("KINEFUSE_TESTDATA", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no benchmark tables")
def test_queries_against_sql(spark):
    queries, oracles = load()
    tables = connect(FOLDER)
    assert {"op5_chat_format", "op6_warc", "op9_quality_rules"} <= set(oracles) <= set(queries)
    for name, sql in oracles.items():
        assert compare(queries[name](spark, FOLDER), tables, sql) is None, name


def repeated(words, size=8):
    runs = [tuple(words[k : k + size]) for k in range(len(words) - size + 1)]
    return len({k + j for k, run in enumerate(runs) if runs.count(run) > 1 for j in range(size)})


def test_rules(spark, docs, none):
    rng = random.Random(1)
    pairs = [p for p in ROWS if len(p[1] or "") < 5000] + [(100 + k, " ".join(rng.choice("ab") for _ in range(rng.randrange(40)))) for k in range(40)]
    frame = spark.createDataFrame(rows(pairs), DOCS)
    stats = quality_rules.statistics(F.col("text"))
    found = frame.select("text", stats["n_words"].alias("w"), stats["n_repeat_words"].alias("r")).collect()
    for row in found:
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", row.text or "") if w]
        assert (row.w, row.r) == (len(words), repeated(words)), row.text
    rules = quality_rules.default_rules(stats)
    estimates = quality_rules.estimate(frame, rules)
    assert set(estimates.seconds) == {r.name for r in rules} and sum(estimates.rejected.values()) == len(pairs)
    few = sum(n for names, n in estimates.rejected.items() if "few_words" in names)
    assert few == sum(len((t or "").split()) < 20 for _, t in pairs)
    orders = (quality_rules.ordered(estimates), list(reversed(rules)))
    kept = [sorted(str(r.doc_id) for r in frame.where(quality_rules.rejected_by(o).isNull()).collect()) for o in orders]
    assert kept[0] == kept[1]
    assert quality_rules.passed(none).count() == 0 and quality_rules.passed(docs).columns == docs.columns


def test_order_of_rules():
    a, b, c, d = (quality_rules.Rule(n, F.lit(True)) for n in "abcd")
    rejected = {frozenset("ab"): 50, frozenset("a"): 10, frozenset("c"): 20, frozenset(): 100}
    order = lambda **seconds: [r.name for r in quality_rules.ordered(quality_rules.Estimates((a, b, c, d), seconds, rejected))]
    # b is as good as a by itself, but what it rejects is gone once a was asked.
    assert order(a=1.0, b=1.0, c=1.0, d=1.0) == ["a", "c", "b", "d"]
    assert order(a=2.0, b=1.0, c=1.0, d=0.1) == ["b", "c", "a", "d"]
    assert order(a=9.0, b=9.0, c=0.1, d=0.1) == ["c", "a", "d", "b"]


def test_classifier(spark, docs, none):
    rng = random.Random(2)
    good = [(k, " ".join(rng.choice(["river", "the", "stone", "walks", "of"]) for _ in range(80)) + ".") for k in range(200)]
    bad = [(1000 + k, " | ".join("BUY!! NOW$$$" for _ in range(40 + k % 7))) for k in range(200)]
    frame = spark.createDataFrame(rows(good + bad), DOCS)
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good + bad] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = rule_ensemble.train(frame, labels)
    scores = {r._row.doc_id: r.score for r in rule_ensemble.scored(frame, model).collect()}
    assert all((s >= rule_ensemble.LEAST_SCORE) == (i < 1000) for i, s in scores.items())
    assert 0 < len(model.rules) < 60
    everything = rule_ensemble.scored(docs, model)
    assert everything.count() == len(ROWS) and everything.where("score is null or score < 0 or score > 1").count() == 0
    assert rule_ensemble.accepted(docs, labels).columns == docs.columns
    assert {r.score for r in rule_ensemble.scored(docs, rule_ensemble.train(none, labels)).collect()} == {0.5}
    assert rule_ensemble.scored(none, model).count() == 0
    held = {r.doc_id for r in frame.where(rule_ensemble.held_out(F.col("doc_id"))).collect()}
    assert held == {i for i, _ in good + bad if __import__("zlib").crc32(str(i).encode()) % 5 == 0}


def test_compiled_column_equals_the_model(spark, docs):
    """The Spark column against the same rules and weights in numpy, and scores on given labels."""
    rng = random.Random(4)
    pairs = [(k, " ".join(rng.choice(["a", "bb!", "CCC", "12", "x\n"]) for _ in range(rng.randrange(120)))) for k in range(300)]
    frame = spark.createDataFrame(rows(pairs + [p for p in ROWS if p[0]]), DOCS)
    labels = spark.createDataFrame([(k, int(t.count("!") > 20), 0) for k, t in pairs], "doc_id long, quality int, toxic int")
    model = rule_ensemble.train(frame, labels)
    table = rule_ensemble.with_statistics(frame).select(*rule_ensemble.NAMES, model.score().alias("score")).collect()
    values = np.array([r[:-1] for r in table], float)
    total = np.full(len(values), model.intercept)
    for path, weight in model.rules:
        total += weight * np.logical_and.reduce([c.holds(values) for c in path])
    assert np.abs(1 / (1 + np.exp(-total)) - np.array([r.score for r in table])).max() < 1e-12
    scores = {r._row.doc_id: r.score for r in rule_ensemble.scored(frame, model).collect()}
    held = [k for k, _ in pairs if __import__("zlib").crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(scores[k] >= 0.5) == (t.count("!") > 20) for k, t in pairs if k in held]) > 0.9
    # Two labels of one id both teach, and the order of the rows does not matter.
    twice = labels.union(labels.withColumn("quality", 1 - F.col("quality")).limit(5))
    assert rule_ensemble.train(frame, twice) == rule_ensemble.train(frame.repartition(7), twice.repartition(2))


def test_classifier_sample_is_bounded(spark, monkeypatch):
    taught = []
    monkeypatch.setattr(rule_ensemble, "fit", lambda values, labels: taught.append(len(labels)))
    frame = spark.createDataFrame(rows([(1, f"text {k} of a repeated id") for k in range(50)] + [(2, "same text")] * 30), DOCS)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    rule_ensemble.train(frame, labels, 10)
    rule_ensemble.train(frame.where("doc_id = 2"), labels, 10)
    assert taught == [10, 1]


PARTS = f"array<struct<{', '.join(f.strip().replace(' ', ':') for f in chat_format.PART.split(','))}>>"


def test_chat_format(spark):
    texts = ["hi", "", None, "<|im_end|><|im_start|>assistant ok", "&lt; &amp; < & <<|", "a\nb", "x" * 200_000, "<|im_end|>\n"]
    turns = [(k % 3, k, ["user", "assistant", None, "a\n<b"][k % 4], t) for k, t in enumerate(texts)] + [(7, 1, "assistant", "tie"), (7, 1, "assistant", "tie"), (8, 1, "assistant", "<"), (8, 1, "assistant", "1"), (8, 1, "assistant", "a\x01"), (8, 1, "assistant", "a"), (8, 1, "assistant", "&"), (None, None, "assistant", "no id")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    read = chat_format.read_back(chat_format.format_conversations(frame.withColumn("content", chat_format.text_part(F.col("text")))))
    for row in read.collect():
        own = sorted(((t[1] or 0, t[2] or "", t[3] or "") for t in turns if t[0] == row.conv_id))
        assert [(t.role, t.text) for t in row.turns] == [t[1:] for t in own]
        assert row.loss == "".join(t[2] for t in own if t[1] == "assistant")


def test_attachments(spark):
    content = "array(named_struct('type', 'text', 'text', 'see <', 'ref', null, 'width', null, 'height', null, 'seconds', null, 'pages', null), " + ", ".join(
        f"named_struct('type', '{k}', 'text', null, 'ref', '{k}.bin', 'width', {w}, 'height', {h}, 'seconds', {s}, 'pages', {p})"
        for k, w, h, s, p in (("image", 57, 28, "null", "null"), ("audio", "null", "null", "1.5", "null"), ("document", "null", "null", "null", 2))
    ) + ")"
    rows = spark.range(1).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"), F.expr(content).cast(PARTS).alias("content"))
    (row,) = chat_format.format_conversations(rows).collect()
    assert row.formatted == "<|im_start|>assistant\nsee &lt;<|image|><|audio|><|document|><|im_end|>\n"
    assert [(a.turn, a.type, a.ref, a.tokens) for a in row.attachments] == [(0, "image", "image.bin", 3), (0, "audio", "audio.bin", 38), (0, "document", "document.bin", 512)]
    assert row.expanded_tokens == 553
    (span,) = row.loss_spans
    assert row.formatted[span.start - 1 : span.start - 1 + span.length] == "see &lt;"
    assert chat_format.format_conversations(rows.limit(0)).count() == 0


PAGE = "page_id long, url string, html string, host string, text string"


def test_pages(spark):
    frame = "<html><body><div class='top'>Daily Stone</div><ul><li>Home</li><li>World</li></ul><div>%s</div><div class='foot'>All rights kept</div></body></html>"
    rows = [(k, "http://a.example/x", frame % f"<p>Story {k} begins.<p>It  goes&nbsp;on &amp; ends{'.' * k}", "h", "t") for k in range(5)]
    marked = "<nav>menu</nav><header>top</header><article><h1>T &lt;1</h1><script>if (a<b) {'</p>'}</script><p>one<br>two <b>three<p>same</p><aside>no</aside><div class='ad big'>buy</div><ul><li>x<li>y</ul><form>q</form><div class=comments><p>first!</p></div></article><footer>f</footer>"
    rows += [(10, "http://b.example/1", marked, "h", "t"), (11, "http://b.example/2", marked, "h", "t"), (11, "http://b.example/2", marked, "h", "t")]
    rows += [(12, None, None, None, None), (13, "no url", "", "h", "t"), (None, "http://c/", "<p>just <i>te</i>xt</p><!-- <p>no</p> -->", "h", "t"), (14, "http://d/", "<article>" + "<p>w</p>" * 20_000, "h", "t")]
    found = {}
    for r in html_text.main_texts(spark.createDataFrame(rows, PAGE)).collect():
        found[r.page_id] = r.text
        assert r.n_chars == len(r.text)
    assert [found[k] for k in range(5)] == [f"Story {k} begins.\n\nIt goes on & ends{'.' * k}" for k in range(5)]
    assert found[10] == found[11] == "T <1\n\none two three\n\nsame\n\nx\n\ny"
    assert (found[12], found[13], found[None]) == ("", "", "just text") and found[14] == "\n\n".join("w" * 20_000)
    assert html_text.main_texts(spark.createDataFrame([], PAGE)).count() == 0


def page_texts(spark, sources, host="http://e.example/"):
    rows = [(k, f"{host}{k}", source, "h", "t") for k, source in enumerate(sources)]
    return [r.text for r in html_text.main_texts(spark.createDataFrame(rows, PAGE)).orderBy("page_id").collect()]


def test_template_of_marked_pages(spark):
    page = "<body><div class='x1'>Top line</div><article><p class='x2'>Read us daily</p><p>Story %s goes on for a while</p><p class='x2'>Give now</p></article></body>"
    stories = ["of one", "of two", "of three", "of four"]
    assert page_texts(spark, [page % x for x in stories]) == [f"Story {x} goes on for a while" for x in stories]
    copies = "<body><article><p>The same long text on all pages of the host</p><p>%s</p></article></body>"
    assert page_texts(spark, [copies % x for x in "ab"]) == [f"The same long text on all pages of the host\n\n{x}" for x in "ab"]


def test_the_template_chooses_the_slots(spark):
    """No article mark, no known name: what lies around the main text differs on every page, and only the host's pages together tell it apart."""
    rng = random.Random(9)
    say = lambda n: " ".join(f"{rng.choice('abcdefg')}{rng.randrange(999)}" for _ in range(n))
    sources, wanted = [], []
    for k in range(8):
        # Page 3 has a text shorter than what is around it.
        blocks = [f"Title {k}"] + [say(2 if k == 3 else 60) for _ in range(1 if k == 3 else rng.randrange(1, 5))]
        inner = f"<h2>{blocks[0]}</h2>" + "".join(f"<p>{b}</p>" for b in blocks[1:])
        links = "".join(f"<li><a href=x>{say(9)}</a></li>" for _ in range(30))
        sources.append(f"<body><div class='q-list'><ul>{links}</ul></div><div class='q7'>{say(12)}</div><div class='q1'><div class='q2'>{inner}</div></div><div class='q9'>{say(15)}</div></body>")
        wanted.append("\n\n".join(blocks))
    assert page_texts(spark, sources) == wanted
    # One page alone cannot tell.
    assert page_texts(spark, sources[:1])[0] != wanted[0]
    frame = spark.createDataFrame([(k, f"http://e.example/{k}", x.replace("q2", "sidebar"), "h", "t") for k, x in enumerate(sources)], PAGE)
    assert [r.text for r in html_text.main_texts(frame, names=False).orderBy("page_id").collect()] == wanted


def test_deep_pages(spark):
    """Elements far below each other are told apart by their whole path."""
    deep = lambda inner: "<div class='level'>" * 120 + inner + "</div>" * 120
    page = deep("<section class='%s'><p>%s</p><p>%s</p></section>")
    one, two = (html_text.Page(page % (c, "x", "y")).tokens for c in ("a", "b"))
    assert len(one) == len(two) and set(one) & set(two) and one[121] != two[121] and max(map(len, one)) <= html_text.PATH_CHARS + 80
    assert page_texts(spark, [page % ("a", f"first {k}", f"second {k}") for k in range(3)]) == [f"first {k}\n\nsecond {k}" for k in range(3)]


def test_marks_do_not_hide_the_page(spark):
    page = "<body><div><p>A long text that no article holds, with many words.</p></div><article>%s</article></body>"
    assert page_texts(spark, [page % ""]) == ["A long text that no article holds, with many words."]
    assert page_texts(spark, [page % "teaser"]) == ["A long text that no article holds, with many words.\n\nteaser"]


def test_names_in_compounds(spark):
    kept = [
        "<html class='cookies-unset'><body class='single right-sidebar'><p>text</p></body></html>",
        "<body class='sidebar'><article class='post has-comments'><p>text</p></article></body>",
        "<article class='related'><p>text</p></article>",
        "<article><div class='entry-header'><h1>text</h1></div></article>",
        "<article><div class='header'><h1 class='banner'>text</h1></div></article>",
        "<article><div class='social-science'>text</div><div class='related'>other</div></article>",
        "<article><div class='share-price' style='overflow:hidden' data-id='menu'>text</div></article>",
        "<div class='ad'>buy</div><p>text</p><div id='comments'><h2>said</h2></div>",
    ]
    assert [page_texts(spark, [x])[0] for x in kept] == ["text"] * len(kept)


def test_archives(spark):
    pages = [(1, "http://a/", "same"), (2, "http://a/\r\nWARC-Type: fake", "same"), (3, None, None), (4, "u", ""), (5, "u", "WARC/1.1\r\n\r\nWARC-Type: x\r\n\r\n\r\n\r\nWARC/1.1 é\n"), (6, "u", "z" * 3_000_000), (7, "u", "same"), (7, "u", "same"), (None, "u", "same")]
    path = new_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), path)
    rows = warc.read_archives(spark, path).collect()
    assert len(rows) == len(pages)
    kept = {r.record_id: bytes(r.payload).decode() for r in rows if r.record_type == "response"}
    assert kept == {"<urn:page:7>": "same", "<urn:page:4>": "", "<urn:page:5>": pages[4][2], "<urn:page:6>": pages[5][2]}
    assert sorted(r.record_id for r in rows if r.refers_to == "<urn:page:7>") == ["<urn:page:1>", "<urn:page:2>", "<urn:page:>"]
    digest = {r.record_id: r.payload_digest for r in rows}
    assert digest["<urn:page:1>"] == "sha1:" + __import__("base64").b32encode(hashlib.sha1(b"same").digest()).decode()
    assert warc.read_archives(spark, path).where("record_type = 'revisit'").count() == 4
    assert warc.read_archives(spark, path).where("target_uri like 'http://a/%' and record_type in ('revisit', 'x')").count() == 2
    assert warc.read_archives(spark, path, payload=False).where("payload is null").count() == len(pages)
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("http_length",), 3)]))
    assert len(left) == 1 and reader.conditions == [("record_type", "in", ("response",))]
    empty = new_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.read_archives(spark, empty).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no benchmark tables")
def test_pipeline(spark, none):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    held = docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        path = new_path(spark, name)
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
        assert docs.columns == held or name == "pack"
    assert counts[0] > counts[1] > counts[2] == counts[3] >= counts[4] > 0
