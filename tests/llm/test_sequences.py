import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import forest, periodic, private, trie


def brute_runs(words, least=24, power=3):
    found = []
    for p in range(1, len(words) // power + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            s = words[i : j + p]
            if len(s) >= max(least, power * p) and j > i and not any(all(s[k] == s[k + q] for k in range(len(s) - q)) for q in range(1, p)):
                found.append((i, len(s), p))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_match_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        texts = []
        for _ in range(rng.randint(1, 5)):
            n, k = rng.choice([0, 1, 23, 24, 25, 60, 200, 500]), rng.choice([1, 2, 3, 5, 50])
            words = [b"%d" % rng.randrange(k) for _ in range(n)]
            for _ in range(rng.randint(0, 3) if n > 30 else 0):
                a = rng.randrange(n)
                p = 1 + rng.randrange(max(1, (n - a) // 3))
                for i in range(a, min(n, a + p * rng.randint(2, 6) + rng.randrange(p))):
                    words[i] = words[a + (i - a) % p]
            texts.append(words)
        assert periodic.batch_runs(texts) == [brute_runs(t) for t in texts]


def test_transform_finds_exact_copies():
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(0, 3, 400), [10**6]])
    starts = np.arange(0, 384, 16)
    place, distance = periodic._occurrences(x, starts, 16, 16, 32)
    want = {(s, d) for s in starts for d in range(16, 32) if s + d + 16 <= 400 and (x[s : s + 16] == x[s + d : s + d + 16]).all()}
    assert set(zip(place.tolist(), distance.tolist(), strict=True)) == want


def test_detect_edge_cases(spark):
    long_text = "x " * 30_000
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a b " * 20), (5, "a b " * 20), (5, "a b " * 20), (6, long_text), (7, "no break " * 24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("n_words", F.lit("x"))
    got = sorted(periodic.detect(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [len(r.runs) for r in got] == [0, 0, 0, 1, 1, 1, 1, 1]
    assert tuple(got[6 - 1].runs[0]) == (0, 30_000, 1) and got[5].text == "x" and got[0].text == "" and got[7].text == "a b"
    assert periodic.detect(docs.limit(0)).count() == 0
    best = periodic.detect(docs).select("doc_id", periodic.best_run(F.col("runs")).alias("b")).where("doc_id = 5").first()
    assert tuple(best.b) == (0, 40, 2)


@pytest.mark.parametrize(("kind", "n", "bound"), [("random", 200, 40), ("chain", 120, 30), ("star", 150, 20), ("forest", 150, 1000)])
def test_rollup_matches_serial_sums(spark, kind, n, bound):
    rng = random.Random(n)
    parent = {"chain": lambda i: i - 1, "star": lambda i: 0, "random": rng.randrange, "forest": lambda i: rng.choice([None, rng.randrange(i)])}[kind]
    parents = [None] + [parent(i) for i in range(1, n)]
    values = [rng.randrange(100) for _ in range(n)]
    want = values[:]
    for i in range(n - 1, 0, -1):
        if parents[i] is not None:
            want[parents[i]] += want[i]
    nodes = spark.createDataFrame([(i, parents[i], values[i]) for i in range(n)], "id long, parent long, v long")
    assert {r.id: r.v for r in forest.rollup(nodes, ["v"], bound).collect()} == dict(enumerate(want))


def brute_trie(rows, rebuild):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        full[c] = (own.get(c - c % 5, [])[:h] if rebuild else []) + mine[h:]
    nodes = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for node, members in nodes.items():
        below = [m for m in nodes if m[: len(node)] == node]
        parent = min(nodes[node[:-1]]) if node else None
        kids = sum(len(m) == len(node) + 1 for m in below)
        leaves = sum(not any(len(k) == len(m) + 1 and k[: len(m)] == m for k in nodes) for m in below)
        saved = sum((len(nodes[m]) - 1) * len(m[-1][1].encode()) for m in below if m)
        ends = ",".join(str(c) for c in sorted(members) if len(full[c]) == len(node))
        out.add((min(members), len(node), parent, len(members), kids, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def test_trie_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(trie, "ID_RANGE", 8)  # several ranges of ids end at one node
    rng = random.Random(9)
    rows = [(c, t if t else None, rng.choice(["user", None]), rng.choice(["a", "é", "", None])) for c in range(60) for t in range(rng.randint(1, 12))]
    rows += [(None, 1, "user", "lost"), (61, 3, "user", "x"), (61, 3, "user", "x"), (61, 3, "a", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit(1)).withColumn("key", F.lit(""))
    got = trie.trie(table, lambda c: F.crc32(c.cast("string")) % 9, lambda c: c - c % 5)
    assert {tuple(r) for r in got.collect()} == brute_trie(rows, True)
    assert trie.trie(table.limit(0)).count() == 0


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def base_spans(text):
    found = []
    for kind, pattern in BASE:
        for m in re.finditer(pattern, text):
            number = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(number))) % 10 == 0
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(number) <= 19 and luhn, "phone": 9 <= len(number) <= 15}
            if ok[kind]:
                found.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(found)


def test_base_spans_match_the_plain_patterns(spark):
    texts = [
        None, "", "a@b.c_d@e.f x@y x@y@z.w.", "1.2.3.4.5.6.7.8 0001.002.255.256 00.0.0.000", "é\U0001f600 4111 1111 1111 1111 und 4111-1111-1111-1112",
        "+1 (279) 555-0216. call +49 30 123456 - ", "@@ a@-.- ..@x.y 9" * 50, "12" * 2000, "a." * 500 + "@b", "a@" + "b." * 1000 + "c", "+1" + " " * 1000, "1.2.3.4 " * 700,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit(1)).repartition(2)
    for row in private.find(docs).collect():
        base = [s for s in row.spans if s.kind in ("email", "ip", "card", "phone")]
        assert ",".join(f"{s.kind}:{s.start}:{s.end}" for s in base) == base_spans(texts[row.doc_id] or "")
        assert all(s.value == texts[row.doc_id][s.start : s.end] for s in row.spans)


def test_added_kinds_and_scores(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00 ok", "DE88 3704 0044 0532 0130 00", "my ssn 123-45-6789", "part 123-45-6789 here", "call (279) 555-0216", "size 279 555 0216", "+1 (279) 555-0216 call"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.score) for s in r.spans if s.kind in ("iban", "ssn", "phone_local")] for r in private.find(docs).collect()}
    assert got == {0: [("iban", 90)], 1: [], 2: [("ssn", 80)], 3: [], 4: [("phone_local", 80)], 5: [], 6: []}
    assert private.find(docs.limit(0)).count() == 0


def test_a_very_long_run_of_digits_is_searched(spark):
    docs = spark.createDataFrame([(1, "7" * 300_000 + " a@b.co"), (2, "a." * 150_000 + "@b")], "doc_id long, text string").repartition(1)
    assert {r.doc_id: [s.kind for s in r.spans] for r in private.find(docs).collect()} == {1: ["email"], 2: []}


def test_second_doubling_knows_its_rounds(spark, monkeypatch):
    nodes = spark.createDataFrame([(i, i - 1 if i else None, 1) for i in range(20)], "id long, parent long, v long")
    asked, ask = [], type(nodes).isEmpty
    monkeypatch.setattr(type(nodes), "isEmpty", lambda df: asked.append(1) or ask(df))
    assert {r.id: r.v for r in forest.rollup(nodes, ["v"], 8).collect()} == {i: 20 - i for i in range(20)}
    assert len(asked) == 6  # five rounds and the end, in the first pass only
