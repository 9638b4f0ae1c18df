"""All indicators over a stream of bars against the same bars as a batch."""

import pytest

from tests.test_indicators import COLUMNS, SCHEMA, smooth
from tidemark.operators.recursive import RELOCATED
from tidemark.plans.planner import compute, events, preview, request
from tidemark.streaming.tables import stream_bars, stream_events

OPEN = SCHEMA + ", is_final boolean"


def played(spark, folder, parts, start):
    for k, part in enumerate(parts):
        spark.createDataFrame(part, OPEN).coalesce(1).write.parquet(f"{folder}/in/p{k}")
    source = spark.readStream.schema(OPEN).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    start(source).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination(400)


def test_every_indicator_in_a_stream(spark, tmp_path):
    wanted = [request(n, f"{n}_") for n in COLUMNS]
    rows, other = smooth(80), smooth(40, seed=9, symbol="b")
    fixed = (*rows[30][:5], rows[30][5] + 1, 5.0)
    forming = (*other[-1][:1], other[-1][1] + 60, 100.0, 101.0, 99.0, 100.5, 7.0)
    parts = [
        [(*r, True) for r in rows[:60] + other] + [(*forming, False), (*rows[3][:1], rows[3][1], 1.0, 1.0, 1.0, 1.0, 1.0, False)],
        [(*r, True) for r in rows[60:]] + [(*fixed, True)],
    ]
    said = []
    played(spark, str(tmp_path), parts, lambda s: stream_bars(s, wanted, str(tmp_path / "bars"), lambda df, n: said.append(df.collect())))
    columns = [c for r in wanted for c in r.columns]
    now, kinds = {}, []
    for part in said:
        for r in part:
            kinds.append(r.kind)
            if r.kind in ("append", "correction"):
                assert (r.kind == "append") == ((r.symbol, r.time) not in now)
                now[r.symbol, r.time] = [r[c] for c in columns]
    whole = [*rows[:30], fixed, *rows[31:], *other]
    want = {(r.symbol, r.time): [r[c] for c in columns] for r in compute(spark.createDataFrame(whole, SCHEMA), wanted).collect()}
    # tests/test_previews.py holds what a forming bar gives against loops over bars.
    (open_,) = preview(spark.createDataFrame(other, SCHEMA), spark.createDataFrame([forming], SCHEMA), wanted).collect()
    want["b", forming[1]] = [open_[c] for c in columns]
    (shown,) = [r for part in said for r in part if r.kind == "preview"]
    now["b", forming[1]] = [shown[c] for c in columns]
    assert set(now) == set(want) and kinds.count("rejected") == 1 and kinds.count("correction") >= 30
    for key, values in want.items():
        for c, x, y in zip(columns, now[key], values):
            assert (x is None) == (y is None) and (x is None or abs(x - y) <= 1e-9 * max(1, abs(y))), (key, c, x, y)


@pytest.mark.parametrize("name", ["ZigZag"])
def test_values_on_other_bars_in_a_stream(spark, tmp_path, name):
    assert name in RELOCATED
    rows = smooth(90)
    parts = [[(*r, True) for r in rows[:50]], [(*r, True) for r in rows[50:]] + [(*rows[20][:5], rows[20][5] + 30, 1.0, True)]]
    held, wanted = set(), request(name)

    def sink(df, n):
        for r in df.collect():
            (held.add if r.op == "append" else held.remove)(tuple(r)[:-1])

    played(spark, str(tmp_path), parts, lambda s: stream_events(s, wanted, str(tmp_path / "bars"), sink))
    fixed = [*rows[:20], (*rows[20][:5], rows[20][5] + 30, 1.0), *rows[21:]]
    assert held == {tuple(r) for r in events(spark.createDataFrame(fixed, SCHEMA), wanted).collect()} and held
