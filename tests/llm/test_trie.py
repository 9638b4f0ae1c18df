"""The prefix trie against one built node by node in plain Python, long and common conversations, and odd rows."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import trie

SHAPE = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0, digest), role, text))
    own = {c: [t[1:] for t in sorted(ts)] for c, ts in own.items()}
    members, made = defaultdict(list), {}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:])
        for d in range(len(made[c]) + 1):
            members[made[c][:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    below = {}
    for node in sorted(members, key=len, reverse=True):
        leaves = sum(below[k][0] for k in children[node]) if children[node] else 1
        saved = sum(below[k][1] for k in children[node]) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
        below[node] = leaves, saved
    out = []
    for node, cs in members.items():
        ends = ",".join(str(c) for c in cs if made[c] == node)
        parent = min(members[node[:-1]]) if node else None
        out.append((min(cs), len(node), parent, len(cs), len(children[node]), *below[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(df):
    return sorted((tuple(r) for r in trie.prefix_trie(df).collect()), key=repr)


def conversations(n, seed):
    draw = random.Random(seed)
    rows = []
    for c in range(0, n):
        if c % 100 == 0 and c % 300:
            continue
        length = 2 if c % 3 == 0 else draw.randrange(1, 9)
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", "common" if c % 3 == 0 else f"é{draw.randrange(3)}") for t in range(length)]
    return rows


def test_nodes_as_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 5)
    rows = conversations(420, 1)
    random.Random(2).shuffle(rows)
    assert run(spark.createDataFrame(rows, SHAPE).repartition(3)) == brute(rows)


def test_a_long_conversation_goes_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(trie, "STRETCH", 4)
    rows = [(7, t, "user", f"t{t // 3}") for t in range(70)] + [(8, t, "user", f"t{t // 3}" if t < 50 else "other") for t in range(90)] + [(0, t, None, "head") for t in range(3)]
    assert run(spark.createDataFrame(rows, SHAPE)) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (1, None, None, None), (1, 0, "", ""), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 0, "user", "lost"), (2, 5, "user", "x" * 100_000), (2, -3, "a", "b"),
        (105, 0, "user", "short"), (203, 0, "ab", "c"), (204, 0, "a", "bc"), (-7, 1, "user", "a"), (-150, 1, "user", "a"), (-100, 1, "user", "lead"), (9_000_000_000_000, 1, "user", "far"),
    ]
    df = spark.createDataFrame(rows, SHAPE)
    assert run(df.withColumn("depth", F.lit(1)).withColumn("k1", F.lit("?")).withColumn("a.b", F.lit(1))) == brute(rows)
    assert run(df.where("1 = 0")) == []
    assert run(df.where("conv_id = 105")) == brute([(105, 0, "user", "short")])


def test_one_key_for_two_sequences_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(F, "xxhash64", lambda *_: F.lit(5).cast("bigint"))
    rows = [(1, t, "user", f"a{t}") for t in range(8)] + [(2, t, "user", f"b{t}") for t in range(8)]
    with pytest.raises(ValueError, match="one key"):
        trie.prefix_trie(spark.createDataFrame(rows, SHAPE))
