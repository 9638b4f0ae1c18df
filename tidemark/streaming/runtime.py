"""Indicators over a stream of bars, at a cost a bar that does not grow with the series.

Of each symbol the last bars are kept, as many as windows reach back and ``history``
more, with their values; of what lies before them, only what it has come to: totals
and last values that window formulas carry on, and the state of folds. A micro-batch
computes the kept bars of the symbols it touches by the plans that batches use, and
gives what has changed.

Final bars after the last one are appended. A final bar for a time that is there is a
correction; folds go on from the nearest state before it, of which one is kept every
``interval`` bars. A bar that is not final is a preview and takes the place of the one
before it; for the time of the last final bar it opens that bar again. A row with a
``command`` takes the last final bar back ("truncate", if nothing is forming) or drops
the preview ("discard"). In a micro-batch commands go first, then final bars, then the
last preview of each symbol. Bars that are too old, and commands that find nothing,
are rejected.

The store is Parquet: a micro-batch writes a part with the kept bars of its symbols, and
every ``COMPACT``-th of all symbols, so that reads do not grow. A part that is written
again by a retry is the same. ``seed`` writes the first part from a batch.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from ..functions.dialect import SPEC, ResumingSql
from ..model import BAR, PRICES
from ..operators.recursive import RECURSIVE, Bar
from ..operators.windowed import WINDOWED
from ..plans.planner import STANDING, Request, layers

BASE = "symbol string, start bigint, revision bigint, carry array<double>, state binary"
HISTORY = 256
INTERVAL = 64
COMPACT = 16

Sink = Callable[[DataFrame, int], None]


def reach(steps: list[dict[str, str]], outputs: dict[str, str]) -> int:
    """How many bars before it a bar's values can depend on, through all layers of windows."""
    total = 0
    for layer in [*steps, outputs]:
        frames = [int(n) for text in layer.values() for n in re.findall(r"ROWS BETWEEN (\d+) PRECEDING", text)]
        lags = [int(n) for text in layer.values() for n in re.findall(r", (\d+)\) OVER", text)]
        total += max([0, *frames, *lags])
    return total


class Runtime:
    """The store in ``folder``, which all executors share, and what is asked of it."""

    def __init__(self, folder: str, requests: list[Request], history: int = HISTORY, interval: int = INTERVAL) -> None:
        self.folder, self.history, self.interval = folder, history, interval
        self.windows = [r for r in requests if r.definition.id in WINDOWED]
        self.folds = [r for r in requests if r.definition.id in RECURSIVE]
        if len(self.windows) + len(self.folds) < len(requests):
            raise ValueError("indicators that place values on other bars have stream_events")
        self.columns = [c for r in requests for c in r.columns]
        if len(set(self.columns)) < len(self.columns):
            raise ValueError(f"output columns clash; give prefixes: {sorted(self.columns)}")
        self.dialect = ResumingSql()
        self.steps, self.outputs = layers(self.windows, self.dialect)
        self.lines = [c for c in self.outputs if not re.fullmatch(r"(carry|among)_\d+", c)]
        self.before = reach(self.steps, self.outputs)
        # Whether a line has had a value is carried like a total.
        self.masked = [c for c in self.lines if c not in {r.prefix + o for r in self.windows for d, o in STANDING if d == r.definition.id}]

    # The store -------------------------------------------------------------

    def _read(self, spark: SparkSession, number: int) -> tuple[DataFrame, DataFrame]:
        """(bases, bars) of each symbol from the last part before ``number`` that has it."""
        last = number // COMPACT * COMPACT - 1
        bases = self._parts(spark, "bases", BASE).where((F.col("part") >= last) & (F.col("part") < number))
        latest = bases.groupBy("symbol").agg(F.max("part").alias("part"))
        bars = self._parts(spark, "bars", self._bar_shape()).where((F.col("part") >= last) & (F.col("part") < number))
        return bases.join(latest, ["symbol", "part"]).drop("part"), bars.join(latest, ["symbol", "part"]).drop("part")

    def _parts(self, spark: SparkSession, kind: str, shape: str) -> DataFrame:
        path = f"{self.folder}/{kind}"
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return spark.createDataFrame([], f"{shape}, part int")
        return spark.read.schema(f"{shape}, part int").option("basePath", path).parquet(path)

    def _bar_shape(self) -> str:
        prices = ", ".join(f"{c} double" for c in PRICES)
        values = "".join(f", `{c}` double" for c in self.columns)
        return f"symbol string, time bigint, {prices}, idx bigint, forming boolean, state binary{values}"

    # One micro-batch ---------------------------------------------------------

    def seed(self, bars: DataFrame) -> DataFrame:
        """Begin with the final ``bars`` of a batch, as part -1 of the store. Gives the values of all bars, as ``compute`` does."""
        new = bars.select(*BAR, F.lit(True).alias("is_final"))
        spark = bars.sparkSession
        done = self._write(self._computed(self._joined(spark, new, -2)[0]), -1, None)
        return done.select(*BAR, *[F.col(f"`{c}`") for c in self.columns])

    def apply(self, batch: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
        """Take a micro-batch in and write its part. Gives (rows by bar, changes by point); both can be read until the next part but ``COMPACT``."""
        spark = batch.sparkSession
        rows, old, rejected = self._joined(spark, batch, number)
        done = self._write(self._computed(rows), number, batch)
        dirty = done.groupBy("symbol").agg(F.min("dirty").alias("dirty"))
        # What was written is read again, so that nothing is computed twice.
        bases = self._parts(spark, "bases", BASE).where(F.col("part") == number)
        now = self._parts(spark, "bars", self._bar_shape()).where(F.col("part") == number).join(dirty.select("symbol"), "symbol", "left_semi")
        return self._by_bar(now, old, dirty, rejected), self._by_point(now, bases, old, dirty)

    def _joined(self, spark: SparkSession, batch: DataFrame, number: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(rows to compute, the rows there were, rejected (symbol, time))."""
        command = F.col("command") if "command" in batch.columns else F.lit(None).cast("string")
        new = batch.select(*BAR, "is_final", command.alias("command"), F.monotonically_increasing_id().alias("at"))
        bases, bars = self._read(spark, number)
        touched = new.select("symbol").distinct()
        bases, old = bases.join(touched, "symbol", "left_semi"), bars.join(touched, "symbol", "left_semi").persist()
        said = new.groupBy("symbol").agg(
            F.coalesce(F.max(F.col("command") == "truncate"), F.lit(False)).alias("truncate"), F.coalesce(F.max(F.col("command") == "discard"), F.lit(False)).alias("discard")
        )
        there = old.groupBy("symbol").agg(
            F.max(F.when(~F.col("forming"), F.col("time"))).alias("last"), F.max(F.when(~F.col("forming"), F.col("idx"))).alias("last_idx"),
            F.max(F.col("forming")).alias("open"),
        )
        info = said.join(bases.select("symbol", "start", "revision", "carry", F.col("state").alias("base_state")), "symbol", "left").join(there, "symbol", "left")
        info = info.withColumns({"start": F.coalesce("start", F.lit(0)), "revision": F.coalesce("revision", F.lit(0)), "open": F.coalesce("open", F.lit(False))})
        first = F.col("start") + F.when(F.col("start") > 0, self.before).otherwise(0)
        info = info.withColumn("first", first)
        drops = F.col("truncate") & (F.col("last_idx") >= F.col("first")) & (~F.col("open") | F.col("discard"))
        info = info.withColumn("cut", F.when(drops, F.col("last")))

        prices = F.struct(*PRICES).alias("prices")
        finals = new.where("command is null and is_final").groupBy("symbol", "time").agg(F.max_by(F.struct(*PRICES), "at").alias("prices"))
        opened = new.where("command is null and not is_final").groupBy("symbol").agg(F.max_by(F.struct("time", F.struct(*PRICES).alias("prices")), F.struct("time", "at")).alias("preview"))
        kept = old.where("not forming").select("symbol", "time", "idx", prices, F.col("state").alias("ladder"))
        kept = kept.join(info.select("symbol", "cut", "first"), "symbol").where("cut is null or time < cut")
        known = kept.select("symbol", "time", F.col("idx").alias("known"))
        placed = finals.join(info.select("symbol", "last", "cut", "first"), "symbol").join(known, ["symbol", "time"], "left")
        end = F.when(F.col("cut").isNull(), F.col("last"))
        placed = placed.withColumn("later", F.col("last").isNull() | (F.col("time") > F.col("last")) | (F.col("cut").isNotNull() & (F.col("time") >= F.col("cut"))))
        good = placed.where("later or known >= first")
        late = placed.where("not (later or coalesce(known >= first, false))").select("symbol", "time")

        merged = kept.drop("cut", "first").join(good.select("symbol", "time", F.col("prices").alias("new")), ["symbol", "time"], "full")
        final = merged.select("symbol", "time", F.coalesce("new", "prices").alias("prices"), F.col("new").isNotNull().alias("fresh"), "ladder", F.lit(False).alias("forming"))
        ends = final.groupBy("symbol").agg(F.max("time").alias("end"))
        standing = old.where("forming").select("symbol", F.struct("time", prices).alias("held"))
        shown = info.select("symbol", "discard").join(ends, "symbol", "left").join(opened, "symbol", "left").join(standing, "symbol", "left")
        asked = F.col("preview").isNotNull() & (F.col("end").isNull() | (F.col("preview.time") >= F.col("end")))
        stays = F.col("held").isNotNull() & ~F.col("discard") & (F.col("end").isNull() | (F.col("held.time") > F.col("end")))
        shown = shown.withColumn("row", F.when(asked, F.col("preview")).when(stays, F.col("held")))
        early = shown.where(F.col("preview").isNotNull() & ~asked).select("symbol", F.col("preview.time").alias("time"))
        forming = shown.where("row is not null").select("symbol", "row.time", "row.prices", F.lit(True).alias("fresh"), F.lit(None).cast("binary").alias("ladder"), F.lit(True).alias("forming"))
        # A preview for the time of the last final bar takes that bar's place.
        reopened = forming.select("symbol", F.col("time").alias("_reopened"))
        final = final.join(reopened, "symbol", "left").where("_reopened is null or time <> _reopened").drop("_reopened")
        touch = final.unionByName(forming).where("fresh").groupBy("symbol").agg(F.min("time").alias("touched"))
        empty = info.where("truncate and cut is null").select("symbol", F.lit(None).cast("bigint").alias("time"))

        every = final.unionByName(forming).join(info.select("symbol", "start", "revision", "carry", "base_state", "cut", "first"), "symbol").join(touch, "symbol", "left")
        dirty = F.least(F.coalesce("touched", "cut"), F.coalesce("cut", "touched"))
        rows = every.select("symbol", "time", "prices.*", "forming", "ladder", "start", "revision", "carry", "base_state", F.coalesce(dirty, F.lit((1 << 63) - 1)).alias("dirty"))
        return rows, old, late.unionByName(early).unionByName(empty)

    def _computed(self, rows: DataFrame) -> DataFrame:
        df = rows.withColumns({"i": F.expr(f"row_number() OVER ({SPEC}) - 1 + start"), "size": F.expr("count(*) OVER (PARTITION BY symbol)") + F.col("start")})
        for layer in self.steps:
            df = df.withColumns({name: F.expr(text) for name, text in layer.items()})
        hidden = [c for c in self.outputs if c not in self.lines]
        df = df.withColumns({name: F.expr(text).cast("double") for name, text in self.outputs.items()} or {"_none": F.lit(None)})
        seen = {}
        for k, c in enumerate(self.masked):
            at = F.coalesce(F.col("carry")[self.dialect.slots + k], F.lit(0.0))
            seen[f"seen_{k}"] = F.greatest(at, F.expr(f"max(CASE WHEN `{c}` IS NOT NULL AND NOT forming THEN 1.0D ELSE 0.0D END) OVER ({SPEC} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
        df = df.withColumns(seen) if seen else df
        masks = {c: F.when(~F.col("forming") | (F.col(f"seen_{k}") > 0), F.col(f"`{c}`")) for k, c in enumerate(self.masked)}
        carried = F.array(*[F.col(f"carry_{k}") for k in range(self.dialect.slots)], *[F.col(f"seen_{k}") for k in range(len(self.masked))]).cast("array<double>")
        counted = [c for c in hidden if c.startswith("among_")]
        df = df.withColumn("after", carried).withColumns(masks) if masks else df.withColumn("after", carried)
        df = df.select(*BAR, "forming", "ladder", "base_state", "dirty", "size", "start", "revision", "after", "carry", F.col("i").cast("bigint").alias("idx"), *counted, *[F.col(f"`{c}`") for c in self.lines])
        return self._folded(df)

    def _folded(self, df: DataFrame) -> DataFrame:
        """Values of folds, and their states. Bars before the first that changed are stepped over from the nearest state on."""
        names = [c for r in self.folds for c in r.columns]
        if not names:
            return df.withColumn("state", F.lit(None).cast("binary"))
        reserve = self.before + self.history + 2 * self.interval
        made, interval, kept = [(RECURSIVE[r.definition.id], r.resolved) for r in self.folds], self.interval, df.columns
        place = {c: kept.index(c) for c in (*BAR, "forming", "ladder", "base_state", "dirty", "idx", "size")}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            symbol, folds, waiting, nearest = object(), [], [], None

            def caught_up() -> list:
                """Folds after the bars that are waiting."""
                live = pickle.loads(nearest) if nearest is not None else [cls(dict(p)) for cls, p in made]
                for bar in waiting:
                    for f in live:
                        f.commit(bar)
                return live

            for batch in batches:
                columns = [batch.column(place[c]).to_pylist() for c in place]
                values, states = [], []
                for *row, forming, ladder, base, dirty, i, size in zip(*columns):
                    if row[0] != symbol:
                        symbol, folds, waiting, nearest = row[0], None, [], base
                    bar = Bar(i, *row[1:])
                    if row[1] < dirty:  # known already, and so are its values
                        values.append((None,) * len(names))
                        states.append(ladder)
                        waiting.append(bar)
                        if ladder is not None:
                            nearest, waiting = ladder, []
                        continue
                    if folds is None:
                        folds = caught_up()
                    values.append(tuple(x for f in folds for x in (f.preview(bar) if forming else f.commit(bar))))
                    keep = not forming and (i + 1) % interval == 0 and i >= size - reserve
                    states.append(pickle.dumps(folds) if keep else None)
                new = [pa.array(c, pa.float64()) for c in zip(*values)] if values else [pa.array([], pa.float64()) for _ in names]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new, pa.array(states, pa.binary())], [*kept, *names, "state"])

        shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"`{c}` double" for c in names), "state binary"])
        # The windows before have dealt symbols to partitions, but may have left bars of one kind together.
        return df.sortWithinPartitions("symbol", "time").mapInArrow(run, shape)

    def _write(self, computed: DataFrame, number: int, batch: DataFrame | None) -> DataFrame:
        """Write the kept bars and what lies before them; gives what was computed. A tail starts where a state of the folds is, or at the first bar."""
        spark = computed.sparkSession
        folder = f"{self.folder}/work/{number % 2}"
        computed.write.mode("overwrite").parquet(folder)
        done = spark.read.schema(computed.schema).parquet(folder)
        # Values of folds on bars that were passed over are those that are kept.
        names = [c for r in self.folds for c in r.columns]
        if names and batch is not None:
            _, bars = self._read(spark, number)
            was = bars.select(F.col("symbol").alias("_symbol"), F.col("time").alias("_time"), F.col("forming").alias("_forming"), *[F.col(f"`{c}`").alias(f"_{c}") for c in names])
            done = done.join(was, (done["symbol"] == was["_symbol"]) & (done["time"] == was["_time"]) & ~was["_forming"] & ~done["forming"], "left")
            done = done.withColumns({c: F.when(F.col("time") < F.col("dirty"), F.col(f"`_{c}`")).otherwise(F.col(f"`{c}`")) for c in names})
        written = done
        last = done.where("not forming").groupBy("symbol").agg(F.max("idx").alias("_end"))
        done = done.join(last, "symbol", "left")
        recent = F.col("idx") > F.col("_end") - self.history
        needed = F.col("idx") > F.col("_end") - self.history - self.before
        over = "OVER (PARTITION BY symbol ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
        for k, n in enumerate(self.dialect.kinds):
            mine = F.coalesce(F.col(f"among_{k}"), F.lit(0.0))
            done = done.withColumn(f"_in_{k}", F.when(recent, 0.0).otherwise(mine))
            needed = needed | (F.expr(f"sum(_in_{k}) {over}") <= n)
        done = done.withColumn("_needed", needed | F.col("forming"))
        starts = done.where("_needed").groupBy("symbol").agg(F.min("idx").alias("_want"))
        done = done.join(starts, "symbol")
        # The last bar before the wanted start that has a state (any, where there are no folds) is let go with all before it.
        gone = F.col("state").isNotNull() if names else F.lit(True)
        let = done.where((F.col("idx") < F.col("_want")) & gone).groupBy("symbol").agg(F.max_by(F.struct((F.col("idx") + 1).alias("start"), "after", "state"), "idx").alias("b"))
        bases = done.groupBy("symbol").agg(F.max("revision").alias("revision"), F.max("start").alias("was"), F.first("carry", ignorenulls=True).alias("carry"), F.first("base_state", ignorenulls=True).alias("old"))
        bases = bases.join(let, "symbol", "left").select(
            "symbol", F.coalesce("b.start", "was").alias("start"), (F.col("revision") + 1).alias("revision"),
            F.when(F.col("b").isNull(), F.col("carry")).otherwise(F.col("b.after")).alias("carry"), F.when(F.col("b").isNull(), F.col("old")).otherwise(F.col("b.state")).alias("state"),
        )
        bars = done.join(bases.select("symbol", F.col("start").alias("_from")), "symbol").where("idx >= _from").select("symbol", "time", *PRICES, "idx", "forming", "state", *[F.col(f"`{c}`") for c in self.columns])
        if batch is not None and number % COMPACT == COMPACT - 1:
            old_bases, old_bars = self._read(spark, number)
            touched = batch.select("symbol").distinct()
            bases = bases.unionByName(old_bases.join(touched, "symbol", "left_anti"))
            bars = bars.unionByName(old_bars.join(touched, "symbol", "left_anti"))
        bases.write.mode("overwrite").parquet(f"{self.folder}/bases/part={number}")
        bars.write.mode("overwrite").parquet(f"{self.folder}/bars/part={number}")
        if number % COMPACT == COMPACT - 1:
            self._drop(spark, number - COMPACT)
        return written

    def _drop(self, spark: SparkSession, before: int) -> None:
        """Parts that a whole one has replaced, but the last of those, from which a retry reads."""
        context = spark.sparkContext
        for part in range(before - COMPACT, before):
            for kind in ("bases", "bars"):
                there = context._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}/part={part}")
                there.getFileSystem(context._jsc.hadoopConfiguration()).delete(there, True)

    # What has changed ----------------------------------------------------------

    def _by_bar(self, now: DataFrame, old: DataFrame, dirty: DataFrame, rejected: DataFrame) -> DataFrame:
        """(symbol, time, kind, outputs): append, correction where a value changed, preview, remove for bars taken back, or rejected."""
        was = old.select(F.col("symbol").alias("_symbol"), F.col("time").alias("_time"), F.col("forming").alias("_forming"), *[F.col(f"`{c}`").alias(f"_{c}") for c in self.columns])
        after = now.join(dirty, "symbol").where(F.col("time") >= F.col("dirty"))
        met = after.join(was, (after["symbol"] == was["_symbol"]) & (after["time"] == was["_time"]), "left")
        differs = F.lit(False)
        for c in self.columns:
            differs = differs | ~F.col(f"`{c}`").eqNullSafe(F.col(f"`_{c}`"))
        fresh = F.col("_time").isNull() | F.col("_forming")
        kind = F.when(F.col("forming"), "preview").when(fresh, "append").when(differs, "correction")
        values = [F.col(f"`{c}`") for c in self.columns]
        none = [F.lit(None).cast("double").alias(c) for c in self.columns]
        said = met.withColumn("kind", kind).where("kind is not null").select("symbol", "time", "kind", *values)
        gone = old.where("not forming").join(now.where("not forming").select("symbol", "time"), ["symbol", "time"], "left_anti")
        gone = gone.join(now.groupBy("symbol").agg(F.max("time").alias("_top"), F.min("time").alias("_from")), "symbol", "left").where("_from is null or time >= _from")
        return said.unionByName(gone.select("symbol", "time", F.lit("remove").alias("kind"), *none)).unionByName(rejected.select("symbol", "time", F.lit("rejected").alias("kind"), *none))

    def _by_point(self, now: DataFrame, bases: DataFrame, old: DataFrame, dirty: DataFrame) -> DataFrame:
        """(symbol, revision, kind, from_index, op, output_id, target_index, time, value, provisional), removes last and from the end on.

        A bar without a value has no point. ``place`` orders the changes of a revision.
        """

        def long(df: DataFrame) -> DataFrame:
            pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("output_id"), F.col(f"`{c}`").alias("value")) for c in self.columns]))
            return df.select("symbol", "idx", "time", "forming", pairs.alias("p")).select("symbol", "idx", "time", "forming", "p.*").where("value is not null")

        kept = now.join(dirty, "symbol").where(F.col("time") >= F.col("dirty"))
        known = now.select("symbol").unionByName(old.select("symbol")).distinct()
        froms = kept.groupBy("symbol").agg(F.min("idx").alias("first"))
        ends = old.where("not forming").groupBy("symbol").agg(F.max("idx").alias("end"))
        top = now.groupBy("symbol").agg(F.max("idx").alias("top"))
        floor = known.join(bases.select("symbol", "revision", "start"), "symbol", "left").join(froms, "symbol", "left").join(ends, "symbol", "left").join(top, "symbol", "left")
        floor = floor.withColumn("from_index", F.coalesce("first", F.col("top") + 1, "start", F.lit(0)))
        after, was = long(now), long(old)
        was = was.select(F.col("symbol").alias("_symbol"), F.col("idx").alias("_idx"), F.col("time").alias("_time"), F.col("output_id").alias("_output"), F.col("value").alias("_value"), F.col("forming").alias("_forming"))
        met = after.join(was, (after["symbol"] == was["_symbol"]) & (after["idx"] == was["_idx"]) & (after["output_id"] == was["_output"]), "full")
        one = met.select(
            F.coalesce("symbol", "_symbol").alias("symbol"), F.coalesce("idx", "_idx").alias("target_index"), F.coalesce("output_id", "_output").alias("output_id"),
            F.coalesce("time", "_time").alias("time"), "value", "_value", "forming", F.col("_symbol").isNull().alias("new"), F.col("symbol").isNull().alias("gone"),
            (~F.col("value").eqNullSafe(F.col("_value")) | ~F.col("time").eqNullSafe(F.col("_time")) | ~F.col("forming").eqNullSafe(F.col("_forming"))).alias("differs"),
        )
        op = F.when(F.col("gone"), "remove").when(F.col("new"), "append").when(F.col("differs"), "replace")
        found = one.withColumn("op", op).where("op is not null").join(floor, "symbol").where("target_index >= from_index")
        back = F.max((F.col("op") == "remove") | (F.col("from_index") <= F.coalesce("end", F.lit(-1)))).over(W.partitionBy("symbol"))
        kind = F.when(back, "correction").otherwise("update")
        order = F.when(F.col("op") == "remove", -F.col("target_index")).otherwise(F.col("target_index"))
        return found.select(
            "symbol", F.coalesce("revision", F.lit(0)).alias("revision"), kind.alias("kind"), "from_index", "op", "output_id", "target_index", "time", "value", F.coalesce("forming", F.lit(False)).alias("provisional"),
            F.struct((F.col("op") == "remove").alias("last"), order.alias("at"), "output_id").alias("place"),
        )

    # Streams --------------------------------------------------------------------

    def stream(self, bars: DataFrame, sink: Sink, points: bool = False) -> DataStreamWriter:
        """Give ``sink`` the rows by bar, or the changes by point, of each micro-batch of (bar columns, is_final, command).

        Start what comes back with a checkpoint location of its own.
        """

        def each(batch: DataFrame, number: int) -> None:
            held = batch.persist()
            sink(self.apply(held, number)[int(points)], number)
            held.unpersist()

        return bars.writeStream.foreachBatch(each)


def patched(points: DataFrame) -> Column:
    """Sort key under which the changes of ``points`` can be applied one by one."""
    return F.struct("symbol", "revision", "place")
