"""The stream runtime: batch state taken over, bounded tails, corrections, previews, bars taken back, and changes by point."""

import math
import random

import pytest

from tests.test_indicators import COLUMNS, SCHEMA, smooth
from tidemark.plans.planner import compute, preview, request
from tidemark.streaming import runtime as stream_runtime
from tidemark.streaming.runtime import Runtime

OPEN = SCHEMA + ", is_final boolean, command string"
SHORT = {"length": 5, "period": 5, "longPeriod": 9, "shortPeriod": 4, "longMaLength": 9, "shortMaLength": 4}


def bar(r, close):
    return (*r[:3], close + 2, close - 2, close, 5.0)


def batch(spark, rows):
    return spark.createDataFrame([(*r, True, None) if len(r) == 7 else r for r in rows], OPEN)


def values(spark, wanted, rows):
    columns = [c for r in wanted for c in r.columns]
    return {(r.symbol, r.time): [r[c] for c in columns] for r in compute(spark.createDataFrame(rows, SCHEMA), wanted).collect()}


def alike(a, b):
    return (a is None and b is None) or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-8, abs_tol=1e-8))


class Book:
    """What a reader of the rows by bar, and one of the changes by point, knows after each micro-batch."""

    def __init__(self, runtime):
        self.runtime, self.bars, self.points, self.kinds, self.number, self.revision = runtime, {}, {}, [], 0, {}
        self.columns = runtime.columns

    def take(self, df):
        by_bar, by_point = self.runtime.apply(df, self.number)
        self.number += 1
        shown = {k: v for k, v in self.bars.items() if not v[1]}
        for r in by_bar.collect():
            self.kinds.append(r.kind)
            key = r.symbol, r.time
            if r.kind == "remove":
                shown.pop(key, None)
            elif r.kind != "rejected":
                assert (key in shown) == (r.kind == "correction") or r.kind == "preview", (key, r.kind)
                shown[key] = [r[c] for c in self.columns], r.kind == "preview"
        self.bars = shown
        for r in sorted(by_point.collect(), key=lambda r: (r.symbol, r.revision, r.place)):
            key = r.symbol, r.output_id, r.target_index
            assert r.revision > 0 and r.target_index >= r.from_index and r.kind in ("update", "correction")
            assert (key in self.points) == (r.op != "append"), (key, r.op)
            self.revision[r.symbol] = max(self.revision.get(r.symbol, 0), r.revision)
            if r.op == "remove":
                del self.points[key]
            else:
                self.points[key] = r.time, r.value, r.provisional


def check(spark, book, wanted, rows, since=0, forming=None):
    """Rows by bar equal the batch from bar ``since`` on; ``forming`` is a bar after ``rows``."""
    want = values(spark, wanted, rows)
    for key, (found, provisional) in book.bars.items():
        if provisional:
            assert forming is not None and key == (forming[0], forming[1])
            p = preview(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([forming], SCHEMA), wanted).collect()[0]
            expected = [p[c] for c in book.columns]
        else:
            expected = want[key]
        for c, x, y in zip(book.columns, found, expected):
            assert alike(x, y), (key, c, x, y)
    assert {k for k, v in book.bars.items() if not v[1]} == set(list(want)[0:0]) | {(r[0], r[1]) for r in rows[since:]}
    index = {(r[0], r[1]): i for i, r in enumerate(rows)}
    points = {(s, c, index[s, t]): v[k] for (s, t), (v, prov) in book.bars.items() if not prov for k, c in enumerate(book.columns) if v[k] is not None}
    assert {k for k, v in book.points.items() if not v[2]} == set(points)
    assert all(alike(book.points[k][1], v) for k, v in points.items())


@pytest.fixture(scope="module")
def every():
    return [request(n, f"{n}_") for n in COLUMNS]


def test_all_indicators_go_on_from_a_batch_with_bounded_tails(spark, tmp_path, every):
    """A batch of 500 bars, then streams of some each; the store forgets old bars and the values stay those of one batch."""
    rows = smooth(560, symbol="x")
    runtime = Runtime(str(tmp_path), every, history=16, interval=8)
    seeded = {r.time: r for r in runtime.seed(spark.createDataFrame(rows[:500], SCHEMA)).collect()}
    want = values(spark, every, rows)
    assert all(alike(seeded[t][c], v) for (_, t), vs in want.items() if t in seeded for c, v in zip(runtime.columns, vs))
    for number, (a, b) in enumerate(((500, 501), (501, 560))):
        by_bar, _ = runtime.apply(batch(spark, rows[a:b]), number)
        found = {r.time: r for r in by_bar.collect()}
        assert sorted(found) == [r[1] for r in rows[a:b]] and {r.kind for r in found.values()} == {"append"}
        for r in rows[a:b]:
            for c, y in zip(runtime.columns, want["x", r[1]]):
                assert alike(found[r[1]][c], y), (r[1], c, found[r[1]][c], y)
        kept = spark.read.parquet(f"{tmp_path}/bars/part={number}").count()
        assert kept <= runtime.before + 16 + 2 * 8 + 1 + (b - a)


def short():
    return [
        request(n, f"{n}_", **({"length": 5} if n not in ("OnBalanceVolume", "VolumeWeightedAveragePrice", "TimeWeightedAveragePrice", "ParabolicSar", "PriceVolumeTrend") else {}))
        for n in ("SimpleMovingAverage", "ExponentialMovingAverage", "Highest", "OnBalanceVolume", "VolumeWeightedAveragePrice", "TimeWeightedAveragePrice", "MomentumPinball",
                  "RelativeStrengthIndex", "ParabolicSar", "HurstExponent", "PriceVolumeTrend", "DetrendedPriceOscillator")
    ]


def test_corrections_previews_and_bars_taken_back(spark, tmp_path):
    wanted = short()
    rows = smooth(60, symbol="x")
    book = Book(Runtime(str(tmp_path), wanted, history=20, interval=4))
    book.take(batch(spark, rows[:40]))
    forming, other = bar(rows[40], 105.0), bar(rows[40], 95.0)
    book.take(batch(spark, [(*forming, False, None)]))
    book.take(batch(spark, [(*other, False, None)]))  # another preview takes its place
    check(spark, book, wanted, rows[:40], forming=other)
    fixed = [*rows[:30], bar(rows[30], 90.0), *rows[31:40]]
    book.take(batch(spark, [fixed[30]]))  # under the preview, which stays
    check(spark, book, wanted, fixed, forming=other)
    assert book.kinds.count("correction") >= 10
    book.take(batch(spark, [(*other[:2], *[None] * 5, None, "discard")]))
    assert not any(v[1] for v in book.bars.values()) and not any(v[2] for v in book.points.values())
    book.take(batch(spark, [("x", None, *[None] * 5, None, "truncate")]))
    assert ("x", rows[39][1]) not in book.bars and book.kinds[-1] == "remove" and max(k[2] for k in book.points) == 38
    again = bar(rows[38], 107.0)
    book.take(batch(spark, [(*again, False, None)]))  # opens the last final bar again
    check(spark, book, wanted, fixed[:38], forming=again)
    book.take(batch(spark, [again, rows[39], rows[40]]))
    whole = [*fixed[:38], again, rows[39], rows[40]]
    check(spark, book, wanted, whole)
    unknown = (rows[2][0], rows[2][1] + 1, *bar(rows[2], 1.0)[2:])  # no bar has that time, and none can be put in
    book.take(batch(spark, [unknown, (*rows[39], False, None)]))
    assert book.kinds.count("rejected") == 2 and book.revision["x"] <= book.number


def test_gaps_and_parts_written_again(spark, tmp_path, monkeypatch):
    """Two symbols in odd order over more micro-batches than are kept apart, with missing prices; some are run twice."""
    monkeypatch.setattr(stream_runtime, "COMPACT", 3)
    draw, wanted = random.Random(5), short()
    rows = []
    for r in smooth(84, symbol="x"):
        prices = [None if draw.random() < 0.1 else x for x in r[2:]]
        rows.append((*r[:2], *prices))
    others = [("y", *r[1:]) for r in smooth(30, seed=3)]
    book = Book(Runtime(str(tmp_path), wanted, history=8, interval=4))
    for k in range(7):
        part = rows[12 * k : 12 * k + 12] + (others[10 * (k // 3) : 10 * (k // 3) + 10] if k % 3 == 0 else [])
        draw.shuffle(part)
        if k in (2, 4):
            book.runtime.apply(batch(spark, part), book.number)
        book.take(batch(spark, part))
    want = values(spark, wanted, rows) | values(spark, wanted, others)
    assert set(book.bars) == set(want)
    for key, (found, _) in book.bars.items():
        for c, x, y in zip(book.columns, found, want[key]):
            assert alike(x, y), (key, c, x, y)
