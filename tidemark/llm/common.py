"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Texts that a task unpacks at a time.
TEXTS_AT_ONCE = 512
#: What an Arrow batch to a Python task holds at most; Spark's own limit is 10,000 rows of any size.
BATCH_BYTES, BATCH_LIMIT = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    Where it names none, a temporary one is made if all runs on this machine (tests,
    notebooks). On a cluster executors could not read that, so it is an error there.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def parts(batches: Iterator[pa.RecordBatch], rows: int = TEXTS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, so that few texts are unpacked at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def lower_ascii(column: Column | str) -> Column:
    """A-Z to a-z and nothing else; a null text is an empty one."""
    return F.translate(
        F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")),
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
        "abcdefghijklmnopqrstuvwxyz",
    )


def buckets_for(rows: int, per_bucket: int, least: int = 1, most: int = 1 << 20) -> int:
    """How many buckets keep about ``per_bucket`` rows each."""
    return max(least, min(most, -(-rows // per_bucket)))


def running_offsets(counts: DataFrame, keys: list[str], bucket: str, n: str, coarse: int = 512) -> DataFrame:
    """Rows before each bucket, per ``keys``; ``counts`` has a row for each (keys, bucket).

    Buckets are summed in runs of ``coarse`` first, so that no task sorts all of
    them: a run's buckets meet in one task, then the runs' totals do.
    """
    runs = counts.withColumn("_run", F.floor(F.col(bucket) / coarse))
    inner = W.partitionBy(*keys, "_run").orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    outer = W.partitionBy(*keys).orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    totals = runs.groupBy(*keys, "_run").agg(F.sum(n).alias("_total"))
    totals = totals.select(*keys, "_run", F.coalesce(F.sum("_total").over(outer), F.lit(0)).alias("_base"))
    fine = runs.select(*keys, bucket, "_run", F.coalesce(F.sum(n).over(inner), F.lit(0)).alias("_within"))
    same = [fine[k].eqNullSafe(totals[k]) for k in keys] + [fine["_run"] == totals["_run"]]
    joined = fine.join(totals, same)
    return joined.select(*[fine[k] for k in keys], fine[bucket], (F.col("_within") + F.col("_base")).alias("before"))


def numbered(df: DataFrame, keys: list[str], bucket: str, order: list[Column], out: str) -> DataFrame:
    """``out``: 1-based place of each row per ``keys``, in order of (bucket, order)."""
    counts = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = running_offsets(counts, keys, bucket, "_n").select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col(bucket).alias("_b"), "before"
    )
    within = F.row_number().over(W.partitionBy(*keys, bucket).orderBy(*order))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col(bucket) == F.col("_b")]
    numbered = df.withColumn("_within", within).join(before, same)
    return numbered.withColumn(out, F.col("_within") + F.col("before")).drop("_within", "_b", "before", *[f"_{k}" for k in keys])


#: A key is hot if it holds more than this part of the rows; fewer than so many keys can.
HOT = 1000


def join_counted(rows: DataFrame, groups: DataFrame, keys: list[str], n: str, total: int, how: str) -> DataFrame:
    """``rows`` with the columns of ``groups``, a row for each key, as "left" or "inner".

    ``groups`` has in ``n`` how many of the ``total`` rows have the key. Keys of more
    than a ``HOT``-th of the rows go by a broadcast of fewer than ``HOT`` groups, so
    that no task gets all rows of one of them; the others by an exchange.
    """
    share = F.col(n) * HOT > total
    hot = F.broadcast(groups.where(share))
    few = rows.join(hot, keys)
    rest = rows.join(F.broadcast(groups.where(share).select(*keys)), keys, "left_anti")
    many = rest.hint("merge").join(groups.where(~share), keys, how)
    return few.unionByName(many)


#: Tables made within each open ``scratch``.
_OPEN: list[list[DataFrame]] = []


def table(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the checkpoint folder and read it back.

    For what is wide or long: compressed and columnar where ``cut`` is neither.
    The files go at the end of the ``scratch`` around it, or when the application ends.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    there = context._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(there)
    written = spark.read.schema(df.schema).parquet(path)
    if _OPEN:
        _OPEN[-1].append(written)
    return written


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is run within has Arrow batches of ``BATCH_BYTES``, unless the session has a limit of its own."""
    if spark.conf.get(BATCH_LIMIT, None) is not None:
        yield
        return
    spark.conf.set(BATCH_LIMIT, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(BATCH_LIMIT)


def forget(written: DataFrame) -> None:
    """Delete the files of a ``table`` from which nothing will be read again."""
    context = written.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in written.inputFiles()}:
        if "/table-" in folder:
            there = context._jvm.org.apache.hadoop.fs.Path(folder)
            there.getFileSystem(context._jsc.hadoopConfiguration()).delete(there, True)
    for made in _OPEN:
        made[:] = [t for t in made if t is not written]


def release(context: SparkContext) -> None:
    """Let executors drop shuffle files that no plan refers to any more; Spark does so when the driver collects garbage."""
    gc.collect()
    context._jvm.System.gc()


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables made within go at its end, with the shuffle files behind them, but for those given to what it yields.

    What is read after the end may depend on no other of them.
    """
    made: list[DataFrame] = []
    kept: list[DataFrame] = []
    _OPEN.append(made)

    def keep(written: DataFrame) -> DataFrame:
        kept.append(written)
        return written

    try:
        yield keep
    finally:
        _OPEN.remove(made)
        for written in made:
            if not any(written is k for k in kept):
                forget(written)
        if _OPEN:
            _OPEN[-1].extend(kept)
        if made:
            release(made[0].sparkSession.sparkContext)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores after it, if ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
