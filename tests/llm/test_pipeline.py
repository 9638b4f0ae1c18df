"""The stages of the pipeline on a small corpus, each against brute force on its own input."""

import collections
import hashlib
import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_operators import SCHEMA, brute_components, brute_passages, brute_simhash, edited, prose
from tidemark.llm import quality, simhash

LABELS = "doc_id bigint, quality int, toxic int"


def corpus():
    r = random.Random(21)
    rows, labels = [], []

    def add(text, label=None):
        i = len(rows)
        rows.append((i, text, r.choice(("en", "de", None)), f"s{i % 3}" if i % 5 else "hot", None if text is None else len(text)))
        if label is not None:
            labels.append((i, label, 0))

    for k in range(160):
        good = k % 3 > 0
        add(prose(k, 70) if good else " ".join(w + r.choice(("!!", "$$$", "***")) for w in prose(k, 70).split()), int(good))
    bases = [prose(900 + k, 120) for k in range(6)]
    for k in range(40):
        base = bases[k % 6]
        add(base if k % 4 == 0 else " ".join(edited(base.split(), r.choice((1, 2, 9)), f"e{k}", k)))
    passage = prose(7777, 56)
    for k in range(12):
        add(prose(1200 + k, 90) + " " + passage + "\n" + prose(1300 + k, 90))
    for k in range(12):
        token = hashlib.sha1(str(k).encode()).hexdigest()
        add(prose(1400 + k, 60) + f' mail a{k}@mail.org or api_key = "{token}" ' + prose(1500 + k, 60))
    for text in (None, "", " ", "short", prose(5, 9000), "日本語" * 300):
        add(text)
    return [*rows, rows[3], (None, prose(6, 50), None, None, None)], labels


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What went into each stage and came out of it, in order."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows, labels = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    docs, found = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{name}")
        out = spark.read.parquet(f"{folder}/{name}")
        found[name] = (docs, out)
        docs = out
    return folder, found


def test_stages_are_those_asked_for(stages):
    _, found = stages
    assert list(found) == ["quality", "near_copies", "repeats", "personal_data", "packing"]
    for name in list(found)[:-1]:
        assert found[name][1].columns == SCHEMA.replace(" bigint", "").replace(" string", "").split(", ")


def test_quality_keeps_what_the_model_keeps(spark, stages):
    folder, found = stages
    before, after = (x.collect() for x in found["quality"])
    model = quality.train(found["quality"][0], spark.read.parquet(f"{folder}/labels.parquet"))
    want = [tuple(r) for r in before if quality.Model(model.weights.astype("float32").astype(float), model.slope, model.shift).score(quality.features(r.text)) >= quality.THRESHOLD]
    assert collections.Counter(map(tuple, after)) == collections.Counter(want)
    bad = {r.doc_id for r in before if "$$$" in (r.text or "") and "***" in r.text}
    kept = {r.doc_id for r in after}
    assert len(bad & kept) <= 0.05 * len(bad) and len({r.doc_id for r in before if "@mail.org" in (r.text or "")} - kept) == 0


def test_one_of_each_group_of_near_copies_stays(stages):
    before, after = (x.collect() for x in stages[1]["near_copies"])
    texts = {r.doc_id: r.text for r in before if r.doc_id is not None}
    sets = {i: set(simhash.shingle_set(t).tolist()) for i, t in texts.items()}
    words = {i: (t or "").lower().split() for i, t in texts.items()}
    assert all(len(sets[i]) == len({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}) for i, w in words.items() if w)
    prints = {i: brute_simhash(t) for i, t in texts.items()}

    def alike(a, b):
        common = len(sets[a] & sets[b])
        return (common and common >= 0.8 * (len(sets[a]) + len(sets[b]) - common)) or (prints[a] ^ prints[b]).bit_count() <= 2

    groups = brute_components(sorted(texts), alike)
    want = [tuple(r) for r in before if r.doc_id is None or groups[r.doc_id] == r.doc_id]
    assert collections.Counter(map(tuple, after)) == collections.Counter(want)
    assert len(set(groups.values())) < len(texts) - 10


def test_passages_of_fifty_words_go_everywhere(stages):
    before, after = (x.collect() for x in stages[1]["repeats"])
    want = collections.Counter()
    for row, gone in zip(before, brute_passages(before, 50), strict=True):
        want[row.doc_id, tuple(w for w, g in zip((row.text or "").encode().split(), gone) if not g), row.lang, row.source] += 1
        assert not gone.any() or 50 <= gone.sum() < len(gone) or "a" in row.text
    assert collections.Counter((r.doc_id, tuple((r.text or "").encode().split()), r.lang, r.source) for r in after) == want
    passage = prose(7777, 56)
    assert sum(passage in (r.text or "") for r in before) == 12 and not any(passage in (r.text or "") for r in after)
    assert {r.doc_id for r in before} == {r.doc_id for r in after} and all(r.text is None or r.n_chars == len(r.text) for r in after)


def test_personal_data_goes_and_the_rest_stays(stages):
    before, after = ({r.doc_id: r for r in x.collect()} for x in stages[1]["personal_data"])
    assert set(before) == set(after)
    secret = [i for i, r in before.items() if "@mail.org" in (r.text or "")]
    assert len(secret) == 12
    for i in secret:
        assert not re.search("[0-9a-f]{40}|@mail", after[i].text) and "<email>" in after[i].text
        rest = re.split(r"<[a-z]+>", after[i].text)
        at = 0
        for part in rest:  # what is not a span stands as it stood, in order
            at = before[i].text.index(part, at) + len(part)
    plain = [i for i, r in before.items() if i not in secret and not re.search(r"[0-9]{7}|@", r.text or "")]
    assert sum(before[i].text != after[i].text for i in plain) == 0


def test_every_token_is_packed_once(stages):
    docs, packed = (x.collect() for x in stages[1]["packing"])
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for r in docs:
        n = len(coder.encode(r.text or "", add_special_tokens=False).ids) + 1
        want.update((r.doc_id, k, at, min(4096, n - at)) for k, at in enumerate(range(0, n, 4096)))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length) for r in packed) == want
    held = collections.defaultdict(list)
    for r in packed:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(held) <= -(-sum(r.length for r in packed) // 4096) + 1


def test_empty_tables_and_the_whole_run(spark, stages, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    folder, found = stages
    whole = corpus_pipeline.run(spark, folder).drop("sequence_id", "offset")
    assert whole.exceptAll(found["packing"][1].drop("sequence_id", "offset")).count() == 0 and whole.count() == found["packing"][1].count()
    assert whole.select(F.sum("length")).first()[0] > 0


def test_a_text_whose_id_another_text_has_stays(spark):
    t, u = prose(61, 60), prose(62, 60)
    rows = [(3, t), (5, t), (5, u), (7, u), (8, prose(63, 60)), (8, prose(64, 60)), (None, t)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("_node", F.lit(1)).withColumn("a.b", F.lit(2))
    for options in ({}, {"similarity": simhash.SIMILARITY}):
        out = simhash.keep_one(docs, **options)
        assert out.columns == docs.columns
        kept = [(r[0], r[1]) for r in out.collect()]
        assert len(kept) == 5 and {x for _, x in kept} == {x for _, x in rows}
        assert (3, t) in kept and (None, t) in kept and [k for k, x in kept if x == u] in ([5], [7])


def test_stages_take_columns_of_any_name(spark, tmp_path):
    rows, labels = corpus()
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("_quality", F.lit("mine")).withColumn("a.b", F.lit(1)).withColumn("_gone", F.lit(2)).withColumn("node", F.lit(3))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert set(out.columns) == set(docs.columns), name
        assert out.where("_quality <> 'mine' or `a.b` <> 1 or _gone <> 2 or node <> 3").count() == 0, name
