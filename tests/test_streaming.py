import itertools

import pytest

from tests.test_indicators import SCHEMA, smooth
from tidemark.model import BAR
from tidemark.plans.planner import compute, request
from tidemark.sources.binding import field, output
from tidemark.streaming.folds import Series, stream_folds

WANTED = [request("ema", "e_", length=5), request("rsi", "r_", length=5), request("macdhistogram", "m_")]


def values(spark, rows):
    df = compute(spark.createDataFrame(rows, SCHEMA), WANTED)
    return {(r.symbol, r.time): tuple(r)[len(BAR) :] for r in df.collect()}


def test_stream_equals_batch_with_previews_and_corrections(spark, tmp_path):
    rows = smooth(60) + smooth(60, seed=9, symbol="b")
    schema = SCHEMA + ", is_final boolean"
    parts = [
        [(*r, True) for r in rows if r[1] < rows[30][1]],
        [(*rows[30][:5], rows[30][5] + 5, rows[30][6], False), (*rows[3][:5], 99.0, 1.0, True)],
        [(*r, True) for r in rows if r[1] >= rows[30][1]],
    ]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = (
        stream_folds(source, WANTED).writeStream.format("memory").queryName("folds").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    )
    query.awaitTermination(180)
    got = spark.table("folds").collect()
    final = {}
    for r in got:
        if r.kind == "append":
            final[r.symbol, r.time] = tuple(r)[3:]
    for r in got:
        if r.kind == "correction":
            final[r.symbol, r.time] = tuple(r)[3:]
    fixed = [r if (r[0], r[1]) != ("a", rows[3][1]) else (*rows[3][:5], 99.0, 1.0) for r in rows]
    assert final == values(spark, fixed)
    (preview,) = [r for r in got if r.kind == "preview"]
    closed = [*fixed[:30], (*rows[30][:5], rows[30][5] + 5, rows[30][6])]
    assert tuple(preview)[3:] == values(spark, closed)["a", rows[30][1]]


def test_history_bounds_corrections():
    series = Series(WANTED, history=10)
    rows = [r[1:] for r in smooth(40)]
    whole = Series(WANTED, history=100)
    for r in rows:
        assert series.commit(r) == whole.commit(r)
    assert len(series.bars) == 10
    assert series.correct((rows[5][0], *rows[6][1:])) is None
    changed = (rows[35][0], 90.0, 95.0, 85.0, 91.0, 5.0)
    assert series.correct(changed) == whole.correct(changed)
    assert series.correct(changed) == []


def test_fields_and_outputs_as_inputs(spark):
    df = spark.createDataFrame(smooth(40), SCHEMA)
    lifted = field(df, "hl2").orderBy("time").collect()
    assert all(r.open == r.high == r.low == r.close and r.volume is None for r in lifted)
    first = compute(df, [request("sma", length=5)])
    chained = output(first, "line")
    assert chained.count() == 36
    second = compute(chained, [request("sma", length=3)]).orderBy("time").collect()
    line = [r.line for r in first.orderBy("time").collect()][4:]
    want = [None, None] + [sum(x) / 3 for x in itertools.islice(zip(line, line[1:], line[2:]), 34)]
    assert all((a.line is None) == (b is None) and (b is None or abs(a.line - b) < 1e-9) for a, b in zip(second, want))
    for bad in (lambda: field(df, "middle"), lambda: output(first, "nothing")):
        with pytest.raises(ValueError):
            bad()
