"""Exact duplicates against groups made in plain Python, the perfect hash, and odd rows."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup

SHAPE = "doc_id bigint, text string"


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub("[\x20\x09-\x0d]+", " ", text or "")].append(doc_id)
    found = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        staying = 1
        for i in ids:
            kept = i == keep and staying == 1
            staying -= kept
            found.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(found, key=repr)


def run(df, **options):
    out = exact_dedup.find_repeats(df, **options)
    return sorted((tuple(r) for r in out.select("id", "keep_id", "group_size", "kept", F.lower(F.hex("digest"))).collect()), key=repr)


@pytest.mark.parametrize("n", [0, 1, 7, 5000])
def test_perfect_hash_is_minimal_and_survives_packing(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 256, (n, 32), dtype=np.uint8), axis=0)
    made = exact_dedup.PerfectHash.of(keys)
    again = exact_dedup.PerfectHash.unpacked(**made.packed())
    assert sorted(again.slots(keys)) == list(range(len(keys)))
    others = np.random.default_rng(n + 1).integers(0, 256, (100, 32), dtype=np.uint8)
    assert (again.slots(others) < max(len(keys), 1)).all()


def test_keys_without_a_place_on_any_level_are_listed(monkeypatch):
    monkeypatch.setattr(exact_dedup, "LEVELS", 1)
    keys = np.random.default_rng(5).integers(0, 256, (500, 32), dtype=np.uint8)
    made = exact_dedup.PerfectHash.of(keys)
    assert len(made.rest) > 0
    assert sorted(exact_dedup.PerfectHash.unpacked(**made.packed()).slots(keys)) == list(range(500))


def test_groups_as_by_brute_force_with_a_hot_one(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "PER_SHARD", 50)
    monkeypatch.setattr(exact_dedup, "PER_PART", 16)
    draw = random.Random(3)
    rows = [(i, "the same\t text" if i % 3 == 0 else f"text {draw.randrange(200)} {' ' * draw.randrange(1, 4)}é") for i in range(900)]
    draw.shuffle(rows)
    assert run(spark.createDataFrame(rows, SHAPE).repartition(5)) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "\n\t"), (5, "a b"), (6, "a  b"), (7, "a b"), (None, "a b"), (None, "only"), (8, "x" * 200_000), (9, "x" * 200_000), (5, "a b"), (-4, "a\x0bb")]
    df = spark.createDataFrame(rows, SHAPE).withColumn("n", F.lit(1)).withColumn("digest", F.lit("?")).withColumn("a.b", F.lit(0)).withColumn("place", F.lit(0))
    assert run(df) == brute(rows)
    assert run(spark.createDataFrame([], SHAPE)) == []
    assert run(spark.createDataFrame([(None, "a"), (None, "a")], SHAPE)) == brute([(None, "a"), (None, "a")])


def test_texts_that_share_a_digest_are_told_apart(spark):
    def weak(text):
        return F.unhex(F.sha2(F.substring(text, 1, 1), 256))

    rows = [(i, f"{'ab'[i % 2]}{i % 5}") for i in range(40)]
    found = exact_dedup.find_repeats(spark.createDataFrame(rows, SHAPE), digest=weak)
    assert sorted(tuple(r) for r in found.drop("digest").collect()) == sorted(r[:4] for r in brute(rows))


def test_a_history_keeps_its_row(spark):
    old = spark.createDataFrame([(10, "a"), (11, "b"), (12, "a")], SHAPE)
    new = spark.createDataFrame([(1, "a"), (2, "c"), (3, "c")], SHAPE)
    found = {r[:4] for r in run(new, history=old)}
    assert found == {(10, 10, 3, True), (12, 10, 3, False), (1, 10, 3, False), (11, 11, 1, True), (2, 2, 2, True), (3, 2, 2, False)}
