"""Any indicator over a stream of bars.

``stream_bars`` has a cost a bar that does not grow with the series. Indicators that
place values on earlier bars have ``stream_events``: final bars are kept as Parquet, a
part for each micro-batch; a micro-batch that is run again writes its part again. Of a
bar that stands in several parts the last one counts, so a final bar that is sent again
is a correction. The symbols that a micro-batch touches are computed from their bars as
they are after it and as they were before it, and ``sink`` gets what differs. Its work
follows the length of the touched series.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from ..model import BAR, PRICES
from ..plans.planner import Request, events
from .runtime import HISTORY, Runtime

Sink = Callable[[DataFrame, int], None]


def _kept(batch: DataFrame, number: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """Bars of the touched symbols after and before a micro-batch, whose final bars become a part."""
    spark = batch.sparkSession
    batch.where("is_final").select(*BAR).write.mode("overwrite").parquet(f"{folder}/part={number}")
    every = spark.read.option("basePath", folder).parquet(folder).where(F.col("part") <= number)
    mine = every.join(batch.select("symbol").distinct(), "symbol", "left_semi")

    def known(parts: DataFrame) -> DataFrame:
        last = F.max_by(F.struct(*PRICES), "part").alias("last")
        return parts.groupBy("symbol", "time").agg(last).select("symbol", "time", "last.*")

    return known(mine), known(mine.where(F.col("part") < number))


def stream_bars(bars: DataFrame, requests: list[Request], folder: str, sink: Sink, history: int = HISTORY) -> DataStreamWriter:
    """Give ``sink`` (symbol, time, kind, outputs) of each micro-batch of (bar columns, is_final, command).

    ``kind`` is append for a new bar, correction where a value of an earlier bar
    changed, preview for the bar that is not final yet, remove for a bar that was taken
    back, or rejected for what is too old. ``runtime`` tells the rest. ``folder`` is one
    that all executors share. Start what comes back with a checkpoint location of its own.
    """
    return Runtime(folder, requests, history).stream(bars, sink)


def stream_events(bars: DataFrame, wanted: Request, folder: str, sink: Sink) -> DataStreamWriter:
    """Give ``sink`` the values that ``planner.events`` adds or takes back, with ``op`` append or remove, for each micro-batch."""

    def each(batch: DataFrame, number: int) -> None:
        after, before = _kept(batch, number, folder)
        new, old = events(after, wanted), events(before, wanted)
        added = new.exceptAll(old).withColumn("op", F.lit("append"))
        sink(added.unionByName(old.exceptAll(new).withColumn("op", F.lit("remove"))), number)

    return bars.writeStream.foreachBatch(each)
