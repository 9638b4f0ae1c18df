"""Divergence of sources against plain Python with whole numbers of any size, and odd rows."""

import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import divergence

SHAPE = "doc_id bigint, text string, lang string, source string"
LETTERS = set("abcdefghijklmnopqrstuvwxyz")


def split(text):
    words, word = [], ""
    for ch in (text or "") + " ":
        low = ch.lower() if ch.isascii() else ch
        if low in LETTERS or not ch.isascii():
            word += low
        elif word:
            words.append(word)
            word = ""
    return words


def brute(rows, least=3, most=200):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source, found = lang or "", source or "", split(text)
        docs[lang].update(set(found))
        counts[lang, source].update(found)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)

        def given(found):
            whole = sum(found[t] for t in kept)
            return {t: 1 + 10**9 * (found[t] + 1) // (whole + len(kept)) for t in kept}

        p = {s: given(counts[lang, s]) for s in sources}
        q = given(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            far = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources - {s}]
            high = [(-((p[s][t] - q[t]) ** 2 // q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(far)), ("term", sorted(high)[:most])):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


def run(spark, rows, **options):
    return sorted(tuple(r) for r in divergence.audit(spark.createDataFrame(rows, SHAPE), **options).collect())


def corpus(n, seed, sources=11):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choices("abcdeéß日", k=draw.randrange(1, 4))) for _ in range(300)]
    rows = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else f"s{draw.randrange(sources)}"
        bias = vocabulary[: 40 + 20 * (len(source) + i % 5)]
        text = " ".join(draw.choice(bias) if draw.random() < 0.9 else draw.choice(bias).upper() + "-1" for _ in range(draw.randrange(0, 60)))
        rows.append((i, text, draw.choice(["de", "en"]), source))
    return rows


@pytest.mark.parametrize("blocks", [2, 4, 8])
def test_every_two_blocks_meet_once(blocks):
    met = [frozenset(p) for r in range(1, blocks) for p in divergence.partners(blocks, r).items()]
    assert len(met) == len(set(met)) == blocks * (blocks - 1) // 2 and all(len(p) == 2 for p in met)
    assert all(len({x for p in divergence.partners(blocks, r).items() for x in p}) == blocks for r in range(1, blocks))


def test_weights_of_large_counts_are_exact():
    counts = np.array([0, 1, 999, 10**12, 8 * 10**14])
    found = divergence.weights(counts, 9 * 10**14, 10**9)
    assert found.tolist() == [1 + 10**9 * (int(c) + 1) // (9 * 10**14 + 10**9) for c in counts]


@pytest.mark.parametrize("blocks, per_slice", [(2, 100_000), (4, 200)])
def test_all_pairs_and_terms_as_by_brute_force(spark, monkeypatch, blocks, per_slice):
    monkeypatch.setattr(divergence, "PER_SLICE", per_slice)
    monkeypatch.setattr(divergence, "HELD", 50)
    rows = corpus(240, 4)
    assert run(spark, rows, blocks=blocks) == brute(rows)


def test_terms_end_at_the_last_rank(spark):
    rows = corpus(120, 9)
    assert run(spark, rows, terms=5, blocks=2) == brute(rows, most=5)


def test_odd_rows(spark):
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, "one one ONE", "en", "b"), (4, "one two", "en", "b"), (5, "one two", "en", "c"), (5, "two", "en", "c"),
        (None, "É é one", "en", None), (7, "x " * 50_000 + "one", "en", "d"), (8, "123 -- @", "xx", "only"), (9, "alone", "xx", "other"), (10, "Straße", "", ""), (11, "straße", "", ""), (12, "STRAßE", None, "z"),
    ]
    assert run(spark, rows, blocks=2) == brute(rows)
    assert run(spark, [], blocks=2) == []
    clashing = spark.createDataFrame(rows, SHAPE).withColumn("term", F.lit("?")).withColumn("slice", F.lit(0)).withColumn("a.b", F.lit(1)).withColumn("n", F.lit(1))
    assert sorted(tuple(r) for r in divergence.audit(clashing, blocks=2).collect()) == brute(rows)
    with pytest.raises(ValueError):
        divergence.audit(clashing, blocks=3)


def test_words_are_counted_as_numbers_in_less_time_than_by_counters():
    draw = random.Random(3)
    known = ["".join(draw.choices("abcdefghij\u00e9", k=6)) for _ in range(20_000)]
    rows = [(f"l{k % 2}", f"s{k % 5}", " ".join(draw.choices(known, k=300)).title()) for k in range(2000)] + [("l0", "none", "1 _ 2"), ("l1", "s1", "")]
    given = pa.record_batch([pa.array(x, pa.string()) for x in zip(*rows)], names=["lang", "source", "text"])

    began = time.process_time()
    occurrences, holders = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        mine = Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text.encode().lower().decode()))
        occurrences[lang, source].update(mine)
        holders[lang, source].update(mine.keys())
    plain = time.process_time() - began
    want = {(*g, t): (n, holders[g][t]) for g, found in occurrences.items() for t, n in found.items()} | {(*g, None): (0, 0) for g in occurrences}

    took = []
    for held in (divergence.HELD, 30_000):
        began = time.process_time()
        out = list(divergence.counted(iter([given]), held))
        took.append(time.process_time() - began)
        met = [r for b in out for r in zip(*(c.to_pylist() for c in b.columns))]
        assert held == 30_000 or len(met) == len(want)
        got = defaultdict(lambda: (0, 0))
        for lang, source, term, n, docs in met:
            got[lang, source, term] = (got[lang, source, term][0] + n, got[lang, source, term][1] + docs)
        assert got == want
    assert took[0] < plain
