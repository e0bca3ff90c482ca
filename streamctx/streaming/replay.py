"""Runs streaming operators over a table: replayed as files, to the end, with the result as files."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stateful import ROCKSDB

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only on one machine, where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own[app]


def stream_session(spark: SparkSession, policy: str = "min") -> SparkSession:
    """A session of the same application in UTC, with state in RocksDB.

    policy: with several inputs, `min` waits for the slowest one; with `max` an idle input holds nothing back, and its late rows are dropped.
    """
    own = spark.newSession()
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"),
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
        # without it each write first reads its key, only to count rows
        "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
        # joins keep their four states in one store; commits write what changed, not the store's files
        "spark.sql.streaming.join.stateFormatVersion": "3",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        # all stores of an executor share 500 MB for what they write and cache; else each has up to 128 MB for itself
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.multipleWatermarkPolicy": policy,
    }.items():
        own.conf.set(key, value)
    return own


#: Rows of a micro-batch's file; a micro-batch of more is several files, up to FILES.
FILE_ROWS, FILES = 50_000, 64


def write_in_order(table: DataFrame, path: str, ts: str, batches: int) -> int:
    """table's rows as files, one micro-batch's after the other's in the order of `ts`, cut at quantiles; the number of files of each micro-batch. Rows without a time are in the first."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    cuts, rows = table.select(F.percentile_approx(us, [i / batches for i in range(1, batches)], 1000), F.count(F.lit(1))).first()
    part = F.lit(0)
    for cut in sorted(set(cuts or [])):
        part = part + F.coalesce((us > cut).cast("int"), F.lit(0))
    least = table.groupBy(part.alias("part")).count().agg(F.min("count"), F.count(F.lit(1))).first() if rows > FILE_ROWS * batches else (0, 0)
    # a file must hold a row, or it isn't written: rows are dealt in turn, and the smallest micro-batch has far more of them than files
    files = max(1, min(FILES, least[0] // FILE_ROWS)) if least[1] == len(set(cuts or [])) + 1 else 1
    for i in range(len(set(cuts or [])) + 1):
        rows_of = table.where(part == i)
        (rows_of.coalesce(1) if files == 1 else rows_of.repartition(files)).write.mode("append").parquet(path)
    return files


def replay(table: DataFrame, build: Callable[[DataFrame], DataFrame], *, policy: str = "min", keys: Sequence[str] = (), ts: str | None = None, batches: int = 5) -> DataFrame:
    """The result of a streaming query over a table's rows. build: from the stream of the rows, the query.

    ts: the rows come in so many micro-batches in the order of this column, so that state is carried from batch to batch; else all at once. The result should hold no timestamps, which sessions show by their zones. keys: of a query in update mode, whose
    result is the last row of each key.
    """
    spark, at = table.sparkSession, f"{shared_dir(table.sparkSession)}/replay-{uuid.uuid4().hex}"
    if ts:
        files = write_in_order(table, f"{at}/in", ts, batches)
    else:
        table.write.parquet(f"{at}/in")
    reader = stream_session(spark, policy).readStream.schema(table.schema)
    out = build((reader.option("maxFilesPerTrigger", files) if ts else reader).parquet(f"{at}/in"))
    if keys:
        save = lambda batch, n: batch.write.mode("overwrite").parquet(f"{at}/out/batch={n}")
        out.writeStream.foreachBatch(save).outputMode("update").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.parquet(f"{at}/out")
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*out.columns), "batch").alias("_row")).select(*[F.col(f"_row.`{c}`") for c in out.columns])
    query = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start(f"{at}/out")
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")
