"""Exact, near and substring deduplication against brute force."""

import hashlib
import itertools
import random

import pandas as pd
import pytest

from tidemark.llm import exact_dedup, near_dedup, substring
from tidemark.llm.components import connected

SCHEMA = "doc_id long, text string, lang string, kept string, digest string, `row` string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", "y", "z") for i, t in rows], SCHEMA).repartition(3)


def lower(text):
    return (text or "").encode().lower().decode()


MIXED = [(1, "Same TEXT"), (2, "same text"), (9, "same text "), (3, None), (4, ""), (5, "Ärger"), (6, "ärger"), (7, "x" * 200_000), (8, "X" * 200_000), (10, "alone"), (11, "same text"), (11, "same text"), (None, "alone")]


@pytest.mark.parametrize("counters", [1, 2, 1000])
def test_exact_matches_brute_force(spark, counters):
    got = exact_dedup.decide(frame(spark, MIXED), counters).collect()
    groups = {}
    for i, t in MIXED:
        groups.setdefault(lower(t), []).append(i)
    want = []
    for i, t in MIXED:
        ids = groups[lower(t)]
        keep = max((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_exact_keeps_one_row_of_each_text(spark):
    docs = frame(spark, MIXED)
    kept = exact_dedup.deduplicate(docs).collect()
    assert sorted(lower(r["text"]) for r in kept) == sorted({lower(t) for _, t in MIXED})
    assert exact_dedup.deduplicate(docs).columns == docs.columns
    assert exact_dedup.decide(docs.limit(0)).count() == 0 and exact_dedup.deduplicate(docs.limit(0)).count() == 0


def test_frequent_digests_are_found(spark):
    rows = [(i, "hot" if i % 3 else f"cold {i}") for i in range(3000)]
    found = exact_dedup.digests(frame(spark, rows)).cache()
    heavy = exact_dedup.frequent(found, 10).collect()
    assert [bytes(r["digest"]) for r in heavy] == [hashlib.sha256(b"hot").digest()]


def brute_sets(text, words):
    w = lower(text).encode().split()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def brute_components(rows, words, percent):
    sets = [brute_sets(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b]:
            shared = len(sets[a] & sets[b])
            if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                root[find(a)] = find(b)
    ids = {}
    for x, (i, _) in enumerate(rows):
        ids.setdefault(find(x), []).append(i)
    return {(i, len(s), min(ids[find(x)])) for x, ((i, _), s) in enumerate(zip(rows, sets))}


def near_rows(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, number = [], 0
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.choice([4, 30, 120]))
        for _ in range(rng.choice([1, 6, 25])):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4, 9])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((number, " ".join(words).upper() if rng.random() < 0.2 else "\n".join(words)))
            number += 1
    return rows + [(number, None), (number + 1, ""), (number + 2, " \t"), (number + 3, "one two"), (number + 4, "One TWO"), (number + 5, "two one")]


@pytest.mark.parametrize(("words", "percent", "bands", "block"), [(3, 85, 25, 1_000_000), (5, 80, 36, 1_000_000), (3, 85, 25, 400)])
def test_near_matches_brute_force(spark, words, percent, bands, block):
    rows = near_rows()
    got = near_dedup.decide(frame(spark, rows), near_dedup.Settings(words=words, percent=percent, bands=bands, block_items=block)).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, words, percent)
    assert len(got) == len(rows) and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_keeps_one_document_of_each_group(spark):
    rows = near_rows(5)
    docs = frame(spark, rows + rows[:3])
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in brute_components(rows, 5, 80)})
    assert near_dedup.deduplicate(docs.limit(0)).count() == 0 and near_dedup.decide(docs.limit(0)).count() == 0


def test_near_with_null_ids(spark):
    got = near_dedup.decide(frame(spark, [(None, "a b c d e f g"), (3, "a b c d e f g"), (None, "z y x w v u")])).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(None, 3, False), (3, 3, True), (None, None, True)}


def test_near_workers_hold_the_sets_of_few_texts_at_a_time():
    texts = [f"{i} a b c d e f" if i % 9 else None for i in range(1200)]
    batch = pd.DataFrame({"doc_id": range(1200), "row": range(1200), "node": [str(i).encode() for i in range(1200)], "text": texts})
    settings = near_dedup.Settings(words=3)
    frames = list(near_dedup._features(settings)(iter([batch, batch[:1]])))
    assert max(map(len, frames)) < 300 and pd.concat(frames)["doc_id"].tolist() == [*range(1200), 0]
    assert [n for f in frames for n in f["n"]] == [len(near_dedup.shingles(t, 3)) for t in [*texts, texts[0]]]
    frames = list(near_dedup._sets(settings)(iter([batch])))
    assert max(map(len, frames)) < 300 and pd.concat(frames)["node"].tolist() == batch["node"].tolist()
    assert all((x.view("uint64") == near_dedup.shingles(t, 3)).all() for x, t in zip((x for f in frames for x in f["items"]), texts))


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 200), (7, 7)]
    got = {tuple(r) for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(1, 41)} | {(200, 100), (300, 100)}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_substring(rows, run, least):
    seen, gone = {}, {}
    parts = {i: [" ".join(t[a:b].split()) for a, b in substring.sentences(t or "")] if t else [] for i, t in rows}
    for i in sorted(parts):
        s = parts[i]
        long_enough = [(a, n) for a in range(len(s)) for n in range(run, len(s) - a + 1) if sum(len(x.split()) for x in s[a : a + n]) >= least]
        shortest = {min(x for x in long_enough if x[0] == a) for a, _ in long_enough}
        shortest |= {max(x for x in long_enough if sum(x) == e) for e in {sum(x) for x in long_enough}}
        for a, n in sorted(shortest):
            if seen.setdefault(tuple(s[a : a + n]), (i, a)) != (i, a):
                gone.setdefault(i, set()).update(range(a, a + n))
    return {i: [x for k, x in enumerate(parts[i]) if k not in gone.get(i, ())] for i in parts}


def test_substring_matches_brute_force(spark):
    rng = random.Random(4)
    line = lambda n: " ".join(rng.choices("abcdefgh", k=n)).capitalize() + rng.choice(".!?")
    passages = [" ".join(line(20) for _ in range(4)), " ".join([line(50), line(4), line(3)]), " ".join([line(28), line(28)])]
    rows = []
    for i in range(60):
        parts = [line(rng.randrange(3, 12)) for _ in range(rng.randrange(1, 6))]
        if rng.random() < 0.5:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(passages))
        rows.append((i, rng.choice([" ", "\n", "\n\n"]).join(parts)))
    rows += [(100, None), (101, ""), (102, " \n "), (103, "no end"), (104, ("Again and again it comes. " * 9).strip()), (105, "Short one. Short two."), (106, "Short one. Short two.")]
    got = {r["doc_id"]: r for r in substring.clean(frame(spark, rows)).collect()}
    want = brute_substring(rows, substring.RUN, substring.LEAST)
    assert {i: [" ".join(r["text"][a:b].split()) for a, b in substring.sentences(r["text"])] for i, r in got.items()} == want
    for p in passages:  # over 50 words: one copy in all is left
        assert sum(" ".join(p.split()) in " ".join(r["text"].split()) for r in got.values()) == 1
    assert got[104]["n_removed"] == 8 and got[100]["text"] == "" and got[106]["n_removed"] == 0


def test_substring_sees_passages_cut_inside_sentences(spark):
    word = map("w{}".format, range(1000))
    line = lambda n: [next(word) for _ in range(n)]
    ends = lambda: " ".join(line(6)).capitalize()
    # 20 + (15 + 15) + 20 and 20 + (13 + 12) + 20 words are equal; the cut sentences begin and end differently.
    for number, whole in enumerate(([15, 15], [13, 12])):
        middle = " ".join(" ".join(line(n)).capitalize() + "." for n in whole)
        head, tail = " ".join(line(20)), " ".join(line(20)).capitalize()
        rows = [(i, f"{ends()} {head}. {middle} {tail} {ends()}.") for i in range(2)]
        got = {r["doc_id"]: r for r in substring.clean(frame(spark, rows)).collect()}
        assert got[0]["text"] == rows[0][1] and got[1]["n_removed"] == len(whole) and middle not in got[1]["text"], number


def test_substring_edge_cases(spark):
    twice = " ".join(f"One two three four five six seven eight number{i}." for i in range(3))
    got = sorted((r["doc_id"] or -1, r["text"], r["n_removed"]) for r in substring.clean(frame(spark, [(1, twice), (1, twice), (2, twice), (None, twice)])).collect())
    assert got == [(-1, "", 3), (1, twice, 0), (1, twice, 0), (2, "", 3)]
    assert substring.clean(frame(spark, []).limit(0)).count() == 0


def test_workers_give_freed_memory_back(monkeypatch):
    from tidemark.llm import common

    given = []
    monkeypatch.setattr(common, "_give_back", lambda: given.append(1))
    assert list(common.lean(lambda batches: (b * 2 for b in batches))(iter([1, 2, 3]))) == [2, 4, 6] and len(given) == 4
