"""Sharding, mixing, rules and packing against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing, packing, rules, sharding

SCHEMA = "doc_id long, text string, source string, shard string, place int, weight double"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "old", 5, 0.5) for i, t, s in rows], SCHEMA).repartition(3)


ROWS = [(i, "word " * (i % 50), f"s{i % 3}") for i in range(600)] + [(7, "word " * 7, "s1"), (None, "null id", "s0"), (None, None, None), (900, "", "s2"), (901, "long " * 40_000, "s2")]


def test_shards_hold_every_record_once(spark):
    docs = frame(spark, ROWS)
    out = sharding.shard(docs, 6, bucket_bytes=2000).collect()
    assert Counter((r["doc_id"], r["text"], r["source"], r["weight"]) for r in out) == Counter((i, t, s, 0.5) for i, t, s in ROWS)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 6)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(6))
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) < 2 * min(sizes)
    again = {r["doc_id"]: r["shard"] for r in sharding.shard(docs.limit(50).select("doc_id"), 6).collect()}
    here = {r["doc_id"]: r["shard"] for r in out}
    assert all(here[i] == s for i, s in again.items())
    assert [r["doc_id"] for r in sorted(out, key=lambda r: (r["shard"], r["slot"]))] != sorted((r["doc_id"] for r in out), key=lambda x: (x is None, x))
    assert sharding.shard(docs.limit(0)).count() == 0


def test_exponent_meets_entropy_or_repetition():
    tokens = {"a": 10_000, "b": 1000, "c": 500, "d": 0}
    t = mixing.exponent(tokens, 0.8, 1000.0)
    assert 0 < t < 1 and math.isclose(mixing.entropy(mixing.weights(tokens, t)), 0.8 * math.log(3), rel_tol=1e-6)
    t = mixing.exponent(tokens, 0.99, 3.0)
    assert math.isclose(max(mixing.passes({k: v for k, v in tokens.items() if v}, mixing.weights(tokens, t)).values()), 3.0, rel_tol=1e-6)
    assert mixing.exponent({"a": 4}) == 1.0 and mixing.exponent({}) == 1.0


def test_mix_takes_any_number_of_sources(spark):
    rows = [(i, "w " * (1 + i % 7), f"site{i}") for i in range(10_050)]
    drawn = mixing.draw(frame(spark, rows))
    assert drawn.select("source").distinct().count() == 10_050


def test_plan_agrees_with_dictionaries(spark):
    tokens = {"a": 10_000, "b": 1000, "c": 500, "d": 0, "e": 500}
    counted = spark.createDataFrame(list(tokens.items()), "source string, tokens long")
    for share, most, budget in ((0.8, 1000.0, None), (0.99, 3.0, None), (0.9, 2.0, 9000)):
        want = mixing.weights(tokens, mixing.exponent(tokens, share, most, budget))
        reads = mixing.passes(tokens, want, budget)
        for known in (100, 0):  # sums on the driver, sums by Spark
            for r in mixing.plan(counted, share, most, budget, known).collect():
                assert math.isclose(r["weight"], want[r["source"]], rel_tol=1e-6) and math.isclose(r["passes"], reads[r["source"]], rel_tol=1e-6)


def test_mix_reaches_weights_and_keeps_every_document(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(1, 60), "big" if i % 3 else f"small{i % 5}") for i in range(1500)] + [(None, None, None), (5000, "", "big"), (7000, "w w", "big"), (7000, "w w", "big")]
    docs = frame(spark, rows)
    drawn = mixing.draw(docs, block_tokens=2000).collect()
    taken, weight, whole = defaultdict(int), {}, Counter()
    for r in drawn:
        taken[r["source"]] += r["tokens"]
        weight[r["source"]] = r["weight"]
        whole[(r["source"], r["pass"])] += 1
    total = sum(taken.values())
    for s, n in taken.items():
        assert abs(n / total - weight[s]) < 0.01, s
    sizes = Counter(s or "" for _, _, s in rows)
    assert all(whole[(s, 0)] == sizes[s] for s in sizes)
    mixed = mixing.mix(docs, block_tokens=2000)
    assert mixed.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in mixed.collect()) == Counter(by_text(drawn, rows))
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.draw(docs.limit(0)).count() == 0


def by_text(drawn, rows):
    text = {(i, s or ""): t for i, t, s in rows}
    return [(r["doc_id"], text[(r["doc_id"], r["source"])]) for r in drawn]


def brute_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rules_match_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", " \t\x0b", "a", "a b", "a b c", "a b c a b c", "x " * 3000, "é # $ |\n\n a\n a\r\n a\n", " nbsp stays one", "NULL\x00x y"]
    texts += ["".join(rng.choice(["a ", "b ", "the ", "und\n", "#x ", "\t", "É ", "Q\r"]) for _ in range(rng.randrange(400))) for _ in range(150)]
    got = {r["doc_id"]: r for r in rules.judge(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        n, *_, repeated = want = brute_rules(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, t
        assert r["base_failed"] == (n < 50 or 100 * repeated > 50 * n) and r["kept"] == (not r["base_failed"] and not r["broken"])
    assert rules.judge(frame(spark, []).limit(0)).count() == 0


def test_rules_keep_prose_and_drop_junk(spark):
    prose = "The harbour of the town was closed by the storm and it is not known for how long. " * 4
    prose = " ".join(f"{w}{i}" if i % 3 == 0 else w for i, w in enumerate(prose.split()))
    junk = {1: prose, 2: prose.upper(), 3: " ".join(w + "#%" for w in prose.split()), 4: "zzkq " * 10 + " ".join(f"qx{i}" for i in range(60)), 5: "\n".join(["the a is of it in to on we"] * 9)}
    got = {r["doc_id"]: (r["kept"], r["base_failed"], set(r["broken"])) for r in rules.judge(frame(spark, [(i, t, "s") for i, t in junk.items()])).collect()}
    assert got[1] == (True, False, set())
    assert not got[2][0] and "shouting_words" in got[2][2] and "symbols_per_word" in got[3][2] and "stop_words" in got[4][2] and got[5][1]


def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    return tokenizers.Tokenizer.from_file(packing.default_tokenizer())


def test_encoder_equals_the_tokenizer():
    real, rng = tokenizer(), random.Random(6)
    own = packing.Encoder(packing.default_tokenizer(), limit=40)
    parts = ["don't", "İstanbul", "ΣΑΣ", "é", "́", "a\x1cb", "x y", " ", "\u0085", "<|endoftext|>", "<|", "12", "½", "ß!", "\n", "\t", " ", "東京", "🙂🙂", "​", "'S", "it's", "l'", "#$%", "\x00", "　"]
    texts = ["", " ", *parts] + ["".join(rng.choices(parts + [" "] * 8, k=30)) for _ in range(300)]
    texts += ["Wort, wort. WORT!! क़ q़ ﬁ ŉ the!'s .'s a.b. ...", "word " * 50]
    for at in range(0, len(texts), 7):
        for t, ids in zip(texts[at : at + 7], own.encode(texts[at : at + 7])):
            assert ids == np.asarray(real.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(t)


def test_packing_places_every_token_once(spark):
    real, rng = tokenizer(), random.Random(7)
    rows = [(i, " ".join(rng.choices(["tide", "mark", "Été", "quay"], k=min(900, int(rng.paretovariate(0.8) * 5)))), "s") for i in range(800)]
    rows += [(1000, None, "s"), (1001, "", None), (None, "no id", "s"), (5, rows[5][1], "s"), (1002, "tide " * 9001, "s")]
    capacity = 256
    got = packing.pack(frame(spark, rows), packing.default_tokenizer(), capacity=capacity, per_partition=300).collect()
    want = Counter()
    for i, t, _ in rows:
        ids = [*real.encode(t or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[(i, piece, at, len(part), zlib.crc32(np.asarray(part, dtype="<u4").tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(places) <= -(-sum(r["length"] for r in got) // capacity) + 4  # one sequence a partition
    assert packing.pack(frame(spark, []).limit(0), packing.default_tokenizer()).count() == 0


def test_bin_completion_beats_best_fit():
    # 10 = 6 + 4 = 5 + 5 = 3 + 3 + 4: longest first would put 6 + 4 and leave 5 + 3.
    for counts, bins in (({6: 2, 4: 2, 5: 2}, 3), ({7: 1, 3: 1, 6: 1, 4: 1, 2: 5}, 3), ({5: 3, 4: 1, 3: 2}, 3)):
        patterns = packing.complete(counts, 10)
        used = Counter()
        for pattern, times in patterns:
            assert sum(pattern) <= 10
            used.update({x: n * times for x, n in Counter(pattern).items()})
        assert used == Counter(counts) and sum(t for _, t in patterns) == bins
    filler = packing.Filler({5: 1, 4: 1, 3: 2}, 10)
    assert sum(filler.best_fit(6)[1]) == 5 and sum(filler.fill(6)) == 6


def test_packing_branches_on_whole_packings():
    # 10 + 9, 8 + 8 + 4, 8 + 6 + 5; and 375 times 13 + 9 + 8, 125 times 13 + 9 + 4 + 4.
    for counts, capacity, bins in (({10: 1, 9: 1, 8: 3, 6: 1, 5: 1, 4: 1}, 20, 3), ({13: 500, 9: 500, 8: 375, 4: 250}, 30, 500)):
        patterns = packing.complete(counts, capacity)
        used = Counter()
        for pattern, times in patterns:
            assert sum(pattern) <= capacity and times > 0
            used.update({x: n * times for x, n in Counter(pattern).items()})
        assert used == Counter(counts) and sum(t for _, t in patterns) == bins


def test_queries_report_their_contract_columns(spark):
    sf = "/root/testdata/sf0.001"
    from tidemark.llm.queries import QUERIES

    out = QUERIES["op1_sharding"](spark, sf)
    assert out.columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    total = docs.select(F.sum(F.octet_length("text") + 8)).first()[0]
    assert out.agg(F.sum("size")).first()[0] == total
