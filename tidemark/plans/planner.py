"""From requests for indicators to one Spark plan.

Window formulas become projections over one window specification: their steps are
laid out by depth, equal steps are computed once, and all requests share one
exchange and one sort. All folds of a request run in one pass of the same sorted
rows (``mapInArrow`` over partitions that hold whole symbols in order of time), a
bar at a time, so memory does not grow with the length of a series.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalog import Definition, definition
from ..functions.dialect import SPEC, Dialect, FormingSql, SparkSql
from ..model import BAR
from ..operators.recursive import RECURSIVE, RELOCATED, Bar
from ..operators.windowed import WINDOWED


#: Whether a bar is still forming, in plans for previews.
FORMING = "forming"


@dataclass(frozen=True)
class Request:
    """An indicator with parameters; ``prefix`` goes before its output columns."""

    definition: Definition
    parameters: tuple[tuple[str, float], ...]
    prefix: str = ""

    @property
    def resolved(self) -> dict[str, float]:
        return dict(self.parameters)

    @property
    def columns(self) -> list[str]:
        return [self.prefix + name for name in self.definition.outputs(self.resolved)]


def request(name: str, prefix: str = "", **parameters: float) -> Request:
    found = definition(name)
    return Request(found, tuple(found.resolve(parameters).items()), prefix)


def layers(requests: Iterable[Request], dialect: Dialect) -> tuple[list[dict[str, str]], dict[str, str]]:
    """Steps of window formulas by depth, each named once, and the outputs' expressions."""
    names: dict[str, str] = {}  # expression -> column
    depth: dict[str, int] = {"i": 1}
    steps: list[dict[str, str]] = []
    outputs: dict[str, str] = {}
    for r in requests:
        formula = WINDOWED[r.definition.id](dialect, r.resolved)
        hidden = dialect.taken()
        local: dict[str, str] = {}

        def named(text: str, local: dict[str, str] = local) -> str:
            if not local:
                return text
            return re.sub(rf"\b({'|'.join(map(re.escape, local))})\b", lambda m: local[m[1]], text)

        for name, text in formula.steps:
            text = named(text)
            if text not in names:
                names[text] = f"s{len(names)}_"
                level = max([depth.get(w, 0) for w in re.findall(r"\w+", text)], default=0) + 1
                depth[names[text]] = level
                while len(steps) < level:
                    steps.append({})
                steps[level - 1][names[text]] = text
            local[name] = names[text]
        for name, text in formula.outputs.items():
            outputs[r.prefix + name] = named(text)
        outputs |= {name: named(text) for name, text in hidden.items()}
    return steps, outputs


#: Outputs that show on a forming bar what final bars put there, or by the bar's number, so that nothing has to have been there before.
STANDING = {("Ichimoku", "senkouA"), ("Ichimoku", "senkouB"), ("Shift", "line")}


def _windowed(bars: DataFrame, requests: list[Request]) -> DataFrame:
    forming = FORMING in bars.columns
    steps, outputs = layers(requests, FormingSql() if forming else SparkSql())
    df = bars.withColumn("i", F.expr(f"row_number() OVER ({SPEC}) - 1"))
    for layer in steps:
        df = df.withColumns({name: F.expr(text) for name, text in layer.items()})
    values = {name: F.expr(text).cast("double") for name, text in outputs.items()}
    if forming:
        df = df.withColumns(values)
        free = {r.prefix + o for r in requests for d, o in STANDING if d == r.definition.id}
        values = {name: F.col(f"`{name}`") if name in free else F.when(~F.col(FORMING) | _formed(name), F.col(f"`{name}`")) for name in outputs}
    return df.select(*bars.columns, *[value.alias(name) for name, value in values.items()])


def _formed(name: str) -> Column:
    """Whether a line has had a value on an earlier bar: a bar that is still forming never is a line's first."""
    return F.expr(f"coalesce(max(CASE WHEN `{name}` IS NOT NULL THEN 1 ELSE 0 END) OVER ({SPEC} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1")


def ordered(bars: DataFrame) -> DataFrame:
    """Whole symbols in order of time. Symbols are dealt by hash, so windows over them need no further exchange."""
    return bars.repartition("symbol").sortWithinPartitions("symbol", "time")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(len(BAR))))


def fold_bars(bars: DataFrame, requests: list[Request], in_order: bool = False) -> DataFrame:
    """Outputs of recursive indicators beside (symbol, time, bar); ``bars`` may have more columns, which are kept.

    ``in_order``: partitions hold whole symbols in order of time already, as rows
    do that come from a window over them.
    """
    made = [(RECURSIVE[r.definition.id], r.resolved) for r in requests]
    names = [c for r in requests for c in r.columns]
    kept = [*BAR, *[c for c in bars.columns if c not in names and c not in BAR]]
    flag = kept.index(FORMING) if FORMING in kept else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, folds, i = object(), [], 0
        for batch in batches:
            out: list[tuple] = []
            flags = repeat(False) if flag is None else batch.column(flag).to_pylist()
            for forming, *row in zip(flags, *(batch.column(k).to_pylist() for k in range(len(BAR)))):
                if row[0] != symbol or not folds:
                    symbol, folds, i = row[0], [cls(dict(p)) for cls, p in made], 0
                bar = Bar(i, *row[1:])
                out.append(tuple(x for f in folds for x in (f.preview(bar) if forming else f.commit(bar))))
                i += 1
            new = [pa.array(c, pa.float64()) for c in zip(*out)] if out else [pa.array([], pa.float64()) for _ in names]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*kept, *names])

    old = ", ".join(f"`{c}` {bars.schema[c].dataType.simpleString()}" for c in kept)
    shape = ", ".join([old, *(f"`{c}` double" for c in names)])
    rows = bars.select(*kept)
    return (rows if in_order else ordered(rows)).mapInArrow(run, shape)


def compute(bars: DataFrame, requests: list[Request]) -> DataFrame:
    """(symbol, time, bar, outputs of all requests): one row for each bar.

    Window formulas come first; recursive indicators follow in one pass over the
    rows as the windows leave them, without another exchange or sort. Indicators
    that place values on earlier bars have ``events``.
    """
    moved = [r.definition.id for r in requests if r.definition.id in RELOCATED]
    if moved:
        raise ValueError(f"{', '.join(moved)} give events, not columns")
    columns = [c for r in requests for c in r.columns]
    if len(set(columns)) < len(columns) or set(columns) & set(BAR):
        raise ValueError(f"output columns clash; give prefixes: {sorted(columns)}")
    folds = [r for r in requests if r.definition.id in RECURSIVE]
    windows = [r for r in requests if r.definition.id in WINDOWED]
    return _computed(bars.select(*BAR), folds, windows).select(*BAR, *columns)


def preview(bars: DataFrame, forming: DataFrame, requests: list[Request]) -> DataFrame:
    """(symbol, time, bar, outputs) for bars that are still forming, one for a symbol at most, after its final ``bars``.

    A forming bar is in no window yet. Most lines give what they would if it closed as
    it is, but extrema reach over it and all bars of the window, some lines hold it
    against the bar before, and a line never starts on it. ``bars`` must have every
    bar of the symbols in ``forming``.
    """
    folds = [r for r in requests if r.definition.id in RECURSIVE]
    windows = [r for r in requests if r.definition.id in WINDOWED]
    both = bars.select(*BAR, F.lit(False).alias(FORMING)).unionByName(forming.select(*BAR, F.lit(True).alias(FORMING)))
    return _computed(both, folds, windows).where(FORMING).select(*BAR, *[c for r in requests for c in r.columns])


def _computed(df: DataFrame, folds: list[Request], windows: list[Request]) -> DataFrame:
    if windows:
        df = _windowed(df, windows)
    if folds:
        # MapInArrow takes all columns of its input, so the windows are never pruned. Windows over bars of one kind leave those together.
        df = fold_bars(df.sortWithinPartitions("symbol", "time") if windows else df, folds, in_order=bool(windows))
    return df


def events(bars: DataFrame, wanted: Request) -> DataFrame:
    """(symbol, output_id, source_index, target_index, report_index, value): values found on one bar and placed on another.

    ``report_index`` is the later of the two. Of several values for one place the
    latest source counts; ``latest`` keeps only that.
    """
    cls, parameters = RELOCATED[wanted.definition.id], wanted.resolved
    shape = "symbol string, output_id string, source_index bigint, target_index bigint, value double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, fold, i = object(), None, 0
        found: list[tuple] = []

        def batch() -> pa.RecordBatch:
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
            cols = [pa.array(c, k) for c, k in zip(zip(*found), kinds)] if found else [pa.array([], k) for k in kinds]
            return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in shape.split(", ")])

        for row in _rows(batches):
            if row[0] != symbol or fold is None:
                symbol, fold, i = row[0], cls(dict(parameters)), 0
            for output, target, value in fold.step(Bar(i, *row[1:])):
                found.append((str(symbol), output, i, target, value))
            i += 1
            if len(found) >= 10_000:
                yield batch()
                found = []
        yield batch()

    out = ordered(bars.select(*BAR)).mapInArrow(run, shape)
    return out.withColumn("report_index", F.greatest("source_index", "target_index"))


def latest(points: DataFrame) -> DataFrame:
    """One value for each (symbol, output, place): that of the latest source."""
    return points.groupBy("symbol", "output_id", "target_index").agg(
        F.max_by("value", "source_index").alias("value"), F.max("source_index").alias("source_index")
    )


def points(computed: DataFrame, wanted: Request) -> DataFrame:
    """The long view: (symbol, indicator, output_id, source_index, time, value) of a request's columns, missing values left out."""
    index = F.row_number().over(_by_time()) - 1
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("output_id"), F.col(c).alias("value")) for c in wanted.columns]))
    wide = computed.withColumn("source_index", index.cast("bigint"))
    long = wide.select("symbol", F.lit(wanted.definition.id).alias("indicator"), "source_index", "time", stacked.alias("p"))
    return long.select("symbol", "indicator", "p.output_id", "source_index", "time", "p.value").where("value is not null")


def _by_time() -> WindowSpec:
    return W.partitionBy("symbol").orderBy("time")
