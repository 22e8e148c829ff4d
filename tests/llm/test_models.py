"""HTML extraction, toxicity, quality and the pipeline: expected results, brute force and held-out accuracy."""

import math
import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from tidemark.llm import html_text, quality, toxicity

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
SF = "/root/testdata/sf0.01"
LONG = "A committee of nine people met on Friday to decide how the old mill by the river should be used after the repairs are done."
SHORT = "Nothing was decided."

# Held out: none of these pages is among the labelled examples.
PAGES = [
    (1, f'<!DOCTYPE html><html><head><title>T</title><script>if (a<b) x="</p>";</script></head><body><nav><a href="/">Home</a></nav><div class="ad">{LONG}</div><article><h1>Mill &amp; river</h1><p><b>Bold start<br><p>{LONG}</p><p>{SHORT}</p></article><footer>&copy; {LONG}</footer>', f"Mill & river\nBold start\n{LONG}\n{SHORT}"),
    (2, f'<body><div class="site-header"><p>The Valley Post</p></div><div id="main"><h2>The mill</h2><p>{LONG}\n\n  {LONG}</p><p>{LONG} &#233;&nbsp;&lt;b&gt;</p></div><div class="left sidebar"><p>{LONG}</p></div><ul class="comment-list"><li>{LONG}</li><li>{LONG}</li></ul></body>', f"The mill\n{LONG} {LONG}\n{LONG} é <b>"),
    (3, f"<main><p>{LONG}</p><form action=/x><p>{LONG}</p><input><button>Send</button></form><!-- {LONG} --><noscript>{LONG}</noscript><p style='display:none'>hidden</p><p>{SHORT}</p></main><aside><p>{LONG}</p></aside>", f"{LONG}\n{SHORT}"),
    (4, f'<body class="has-sidebar"><div class="cookie-banner"><p>{LONG}</p></div><article><header><h1>Head</h1></header><p>{LONG}</p><div class="newsletter-signup"><p>{LONG}</p></div><p>{SHORT}</p></article><section id="comments"><article class="comment"><p>{LONG}</p></article></section></body>', f"Head\n{LONG}\n{SHORT}"),
    (5, None, ""),
    (6, "", ""),
    (7, "<<<", None),
    (8, '<nav><a href="/">Home</a> <a href="/a">About</a></nav>', ""),
    (None, f"<article><p>{LONG}</p></article>", LONG),
]


def test_pages_give_their_main_text(spark):
    rows = [(i, None if i == 5 else "http://x", h, "clash", 3) for i, h, _ in PAGES] + [(1, "http://x", PAGES[0][1], "clash", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = html_text.extract(pages).collect()
    assert len(got) == len(rows)
    want = {i: t for i, _, t in PAGES}
    for r in got:
        if want[r["page_id"]] is not None:
            assert r["text"] == want[r["page_id"]], r["page_id"]
        assert r["n_chars"] == len(r["text"])
    assert html_text.extract(pages.limit(0)).count() == 0


A = "Nine people met in the hall to talk about the bridge, and most of them had walked there through the snow because no bus was running."
B = "The engineer explained that the two outer arches are sound while the middle one has moved by a hand's width since the flood."
C = "Nobody objected."
#: (main part, its text): other texts and shapes than the labelled pages; the last block is often short or a link.
SHAPES = [
    (f"<article><p>Yes.</p><p>No.</p><ul><li><a href=/1>First plan</a></li><li><a href=/2>Second plan</a></li></ul><p>{A}</p></article>", f"Yes.\nNo.\nFirst plan\nSecond plan\n{A}"),
    ("<p>Short tale.</p><p>They came.</p><p>They left.</p>", "Short tale.\nThey came.\nThey left."),
    (f'<div class="post-content category-social"><h2>Bridge</h2><p>{A}</p><p>{B}</p></div>', f"Bridge\n{A}\n{B}"),
    (f'<div class="search-engine-history"><p>{A}</p><p>{C}</p><p>{B}</p></div>', f"{A}\n{C}\n{B}"),
    (f'<section class="legal-news"><h1>Ruling</h1><p>{B}</p><p>{A}</p></section>', f"Ruling\n{B}\n{A}"),
    (f'<div class="article-body share-enabled"><p>{A}</p><p>{B}</p><p>{C}</p></div>', f"{A}\n{B}\n{C}"),
    (f"<main><h1>Plans</h1><p>{A} <button>Play</button>{C}</p><blockquote>{B}</blockquote></main>", f"Plans\n{A} {C}\n{B}"),
    (f"<div><h1>Log</h1><p>{B}</p><p>One.</p><p>Two.</p><p>{A}</p><p>Three.</p></div>", f"Log\n{B}\nOne.\nTwo.\n{A}\nThree."),
    (f'<div id="story"><p>{A}{B}</p><table><tr><td>Arch</td><td>moved</td></tr></table><p>{C} {C}</p></div>', f"{A}{B}\nArch\nmoved\n{C} {C}"),
    (f"<article><h1>Search</h1><h2>Comments on the plan</h2><p>{A}</p><h2>Related work</h2><p>{B}</p></article>", f"Search\nComments on the plan\n{A}\nRelated work\n{B}"),
]
AROUND = [
    ("", ""), ('<nav><a href="/">Start</a> <a href="/m">Map</a></nav><div class="cookie-bar"><p>Cookies help us to run this site.</p></div>', "<footer><p>Valley Post, printed since 1890.</p></footer>"),
    ('<header><p>The Valley Post</p></header><div class="ad"><p>Ten percent off all ladders until Sunday evening.</p></div>', '<div class="sidebar"><p>Weather: cold.</p></div><section class="comments"><h3>2 comments</h3><p>I was there and it is so.</p><p>Me too.</p></section>'),
]


def test_thirty_held_out_pages(spark):
    cases = [(f"<html><body>{before}{main}{after}</body></html>", want) for main, want in SHAPES for before, after in AROUND]
    pages = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "page_id long, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    wrong = [(cases[i][0], got[i]) for i in got if got[i] != cases[i][1]]
    assert len(cases) == 30 and not wrong, wrong


def test_given_pages_give_the_article(spark):
    import html
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?p>|<br>|</?h1>", article)]
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


def test_broken_markup_takes_one_pass():
    for page in ("<a b='" * 20_000, "<!--" * 20_000, "<p" * 20_000, "<b>" * 20_000 + "</p>" * 20_000, "<script>" * 20_000, "x" * 1_000_000, "<li>" * 5000 + "</ul>" * 5000):
        html_text.blocks(page)
    assert [b["text"] for b in html_text.blocks("<p>1 < 2 &amp 3 &am</p>")] == ["1 < 2 & 3 &am"]


def test_nearest_equals_brute_force_cosine():
    rng = random.Random(8)
    vocabulary = [(f"t{i}", rng.randrange(1, 300)) for i in range(60)]
    pairs = lambda: sorted((t, rng.randrange(1, 6)) for t in rng.sample(range(60), rng.randrange(0, 12)))
    examples = [(1000 + i, rng.randrange(2), pairs()) for i in range(500)]
    index = toxicity.build(vocabulary, examples, 500, 0.3)

    def dense(p):
        v = np.zeros(60)
        t, w = index.vector(p)
        v[t] = w
        return v

    matrix = np.array([dense(p) for _, _, p in examples])
    for _ in range(100):
        query = pairs()
        scores = matrix @ dense(query)
        want = sorted(((-s, e) for e, s in enumerate(scores) if s > 0))[: toxicity.NEIGHBOURS]
        got = index.nearest(*index.vector(query))
        assert [e for _, e in got] == [e for _, e in want] or np.allclose([s for s, _ in got], [-s for s, _ in want])
        assert np.allclose([s for s, _ in got], [-s for s, _ in want])


def test_monotone_map_rises():
    rng = random.Random(9)
    knots = toxicity.monotone([(x := rng.random(), int(rng.random() < x), 1.0) for _ in range(500)])
    assert all(a[0] <= b[0] and a[1] <= b[1] for a, b in zip(knots, knots[1:]))
    assert all(abs(v - y) < 0.35 for v, y in knots[3:-3])


def test_toxicity_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    held = [(got[r["doc_id"]]["predicted"], r["toxic"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    right = Counter(held)
    assert right[(1, 1)] >= 0.7 * (right[(1, 1)] + right[(0, 1)]) and right[(1, 0)] <= 0.02 * len(held)


def test_toxicity_learns_nothing_from_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = toxicity.remainder(labels["doc_id"]) == 1
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(held, 1 - labels["toxic"]).otherwise(labels["toxic"]))
    assert toxicity.score(docs, labels).select("doc_id", "score").exceptAll(toxicity.score(docs, flipped).select("doc_id", "score")).count() == 0


def test_models_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a", None, None, None, 1), (2, None, "en", "s", 3, 2), (None, "", "en", "s", 0, 3), (2, None, "en", "s", 3, 2)], "doc_id long, text string, lang string, source string, n_chars long, score int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.score(docs, labels).collect()} == {0.5}
    assert all(r["kept"] for r in quality.score(docs, labels).collect())
    assert quality.keep_good(docs, labels).columns == docs.columns and quality.keep_good(docs, labels).count() == 4
    one = spark.createDataFrame([(1, 1, 1), (2, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, one).count() == 4 and quality.score(docs, one).count() == 4
    assert toxicity.score(docs.limit(0), labels).count() == 0 and quality.score(docs.limit(0), labels).count() == 0


def test_co_training_uses_the_other_view():
    rng = np.random.default_rng(10)
    y = (rng.random(3000) < 0.7).astype(float)
    views = [y[:, None] * 2 + rng.normal(size=(3000, 3)), y[:, None] * 2 + rng.normal(size=(3000, 4))]
    pools, free = [v[80:1500] for v in views], np.ones(1420, dtype=bool)

    def ask(models, quota):
        picked = list(quality.surest(models, pools, np.arange(1420), quota, free.copy()))
        for _, _, rows, _ in picked:
            free[rows] = False
        both = [[p for p in picked if p[0] == view] for view in (0, 1)]
        return [(pools[1 - view][np.concatenate([p[2] for p in found])], np.concatenate([np.full(len(p[2]), float(p[1])) for p in found])) for view, found in enumerate(both)]

    model = quality.co_train([v[:80] for v in views], y[:80], ask)
    a, b, both = model.scores(*[v[1500:] for v in views])
    truth = y[1500:] == 1
    assert ((both > 0.5) == truth).mean() >= max(((a > 0.5) == truth).mean(), ((b > 0.5) == truth).mean()) - 0.005 > 0.9
    assert abs(both.mean() - truth.mean()) < 0.05


def test_surest_pages_of_all_partitions(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(400, quality.CONTENT)), (rng.random(400) < 0.5).astype(float)
    x[:, 0] += 2 * y
    meta = [quality.metadata(None, f"s{int(c)}", None) for c in y]
    models = [quality.Logistic.fit(x, y), quality.Logistic.fit(np.array(meta), y)]
    rows = [(i, None, f"s{int(y[i])}", None, x[i].tolist(), (i * 7919) % 400) for i in range(400)]
    pages = spark.createDataFrame(rows, quality.FIGURES + ", turn long").repartition(7)
    ask, quota, gone = quality._handing(pages), (9, 14), set()
    for _ in range(2):
        got = ask(models, quota)
        want = list(quality.surest(models, [x, np.array(meta)], np.array([r[5] for r in rows]), quota, np.array([i not in gone for i in range(400)])))
        for view in (0, 1):
            rows_, labels = (np.concatenate([part(p) for p in want if p[0] == view]) for part in (lambda p: p[2], lambda p: np.full(len(p[2]), p[1])))
            assert labels.tolist() == got[view][1].tolist()
            other = [x, np.array(meta)][1 - view][rows_]
            assert np.allclose(other, got[view][0])
        gone |= {int(i) for p in want for i in p[2]}
    assert len(gone) > 40


def test_quality_of_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    aside = "crc32(cast(doc_id as string)) % 3 = 1"
    rows = quality.figures(docs)
    model = quality.train(rows, labels.where(f"not {aside}"))
    got = rows.mapInPandas(quality._score(model, 0.5), quality.SCORES).join(labels.where(aside).select("doc_id", "quality"), "doc_id").toPandas()
    good, bad = got[got["quality"] == 1], got[got["quality"] == 0]
    assert len(bad) > 100 and good["kept"].mean() >= 0.98 and (~bad["kept"]).mean() >= 0.85


def test_quality_on_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r["doc_id"]: r["kept"] for r in quality.score(docs, labels).collect()}
    seen = Counter((got[r["doc_id"]], r["quality"]) for r in labels.collect())
    assert seen[(True, 1)] >= 0.98 * (seen[(True, 1)] + seen[(False, 1)]) and seen[(False, 0)] >= 0.85 * (seen[(False, 0)] + seen[(True, 0)])
    kept = {r["doc_id"] for r in quality.keep_good(docs, labels).select("doc_id").collect()}
    assert kept == {i for i, k in got.items() if k}


def test_pipeline_stages_follow_each_other(spark):
    import corpus_pipeline
    from tidemark.llm import near_dedup, packing
    from tidemark.llm.common import stored

    sf = "/root/testdata/sf0.001"
    docs = before = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stored(stage(spark, docs, sf), "stage")
        assert docs.schema == before.schema
        sizes[name] = docs.collect()
    lower = lambda r: r["text"].encode().lower()
    good, exact, near, mixed = sizes.values()
    newest = {}
    for r in good:
        newest[lower(r)] = max(newest.get(lower(r), -1), r["doc_id"])
    assert {r["doc_id"] for r in exact} == set(newest.values())
    assert {r["doc_id"] for r in near} == {r["doc_id"] for r in near_dedup.decide(spark.createDataFrame(exact, before.schema)).where("kept").collect()}
    assert {r["doc_id"] for r in mixed} == {r["doc_id"] for r in near}
    placed = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r["doc_id"] for r in placed if r["piece"] == 0) == Counter(r["doc_id"] for r in mixed)
    used = Counter()
    for r in placed:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= packing.CAPACITY and len(used) <= math.ceil(sum(used.values()) / packing.CAPACITY) * 1.02 + 2


@pytest.mark.parametrize("name", ["op4_quality_rules", "op6_exact_dedup"])
def test_sql_agrees(spark, name):
    import duckdb

    from tidemark.llm.queries import ORACLES, QUERIES

    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = db.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, SF).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda f: sorted(map(str, f[columns].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_repeated_labelled_ids_are_one_example(spark):
    rng = random.Random(2)
    words, tell = [f"w{i}" for i in range(40)], ["vile", "nasty", "scum"]
    rows = []
    for i in range(160):
        bad = i % 4 == 0
        rows.append((i, " ".join(rng.choices(words, k=12) + (rng.choices(tell, k=3) if bad else [])) + ("!!! #|#" if bad else "."), "en", "s", 80))
    labels = spark.createDataFrame([(r[0], int(r[0] % 4 > 0), int(r[0] % 4 == 0)) for r in rows], "doc_id long, quality int, toxic int")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    once = spark.createDataFrame(rows, schema).repartition(2)
    often = spark.createDataFrame(rows + rows[:30] * 4, schema).repartition(3)
    twice = labels.unionByName(labels.limit(50))
    for score in (toxicity.score, quality.score):
        want = {r["doc_id"]: round(r["score"], 9) for r in score(once, labels).collect()}
        got = score(often, twice).collect()
        assert len(got) == 280 and {r["doc_id"]: round(r["score"], 9) for r in got} == want
