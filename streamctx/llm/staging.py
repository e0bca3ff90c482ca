"""Tables written once into the folder that driver and executors share.

Staged tables cut lineage and survive a lost executor. Those that a returned
DataFrame reads stay until the folder is cleared; others are dropped when they have been read.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it has no more bytes than this.
BROADCAST_BYTES = 32 << 20

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

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


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def narrow_batches(spark: SparkSession, size: int = 4 << 20) -> Iterator[None]:
    """Within it, plans give Python workers Arrow batches of at most `size` bytes (and a row), so that long texts don't fill executors' memory."""
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, str(size))
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with narrow_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(df._staged_at)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def fits(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether df, which should be staged as it is summed up, has at most so many bytes: 16 a value, and those of strings."""
    text = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    nested = [48 * F.coalesce(F.size(f"`{f.name}`"), F.lit(0)) for f in df.schema if f.dataType.typeName() == "array"]
    size = F.lit(16 * len(df.columns)).cast("long")
    for part in [*text, *nested]:
        size = size + part
    return (df.agg(F.sum(size)).first()[0] or 0) <= most


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it fits; else df as it is."""
    return F.broadcast(df) if fits(df, most) else df


def free_name(df: DataFrame, name: str) -> str:
    """name, or the first of it with underscores before it that is no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
