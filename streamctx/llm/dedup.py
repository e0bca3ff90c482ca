"""Exact deduplication by a stateful stream.

A log of (digest, doc_id, locator) goes through Structured Streaming. The state
store (RocksDB: on disk, keyed by digest, never expired) keeps of each digest the
smallest doc_id with its content locator, and the number of rows. Copies are
summed within each task before the shuffle, so a group that holds a third of all
rows costs its key's task one row for each task. Digests that were hit more than
once are then checked by full bytes: their texts are read again and grouped by
digest and whole text; a digest with two texts is split by text.

Null texts count as empty, and empty texts are equal to each other. Null ids come after all others. Rows that
repeat a doc_id are rows of their own, told apart by their locators.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import staging

WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """text with each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def least_row() -> Column:
    """The struct of the row with the least doc_id, then locator; null ids come last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("unset"), "doc_id", "locator"))


def fold_stream(log: DataFrame, into: str) -> None:
    """Runs the stream log(digest, doc_id, locator) to its present end.

    Each micro-batch writes the new state of the digests that it touched to
    into/updates/batch_id=N, over what an earlier try of that batch wrote. Run again
    with the same `into`, it goes on where it stopped.
    """
    state = log.groupBy("digest").agg(least_row().alias("first"), F.count(F.lit(1)).alias("group_size"))

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{into}/updates/batch_id={batch_id}")

    query = state.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{into}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB."""
    own = spark.newSession()
    for key, value in {
        "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"),
        "spark.sql.session.timeZone": spark.conf.get("spark.sql.session.timeZone"),
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no space ahead
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
        "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # executors' memory is for other stages afterwards
    }.items():
        own.conf.set(key, value)
    return own


def states(log: DataFrame, files_per_batch: int = 1000) -> DataFrame:
    """(digest, first, group_size) of each digest of a staged log."""
    spark, into = log.sparkSession, staging.new_path(log.sparkSession, "dedup-state")
    stream = stream_session(spark).readStream.schema(log.schema).option("maxFilesPerTrigger", files_per_batch)
    fold_stream(stream.parquet(*{f.rpartition("/")[0] for f in log.inputFiles()} or [into]), into)
    updates = spark.read.schema("digest string, first struct<unset: boolean, doc_id: bigint, locator: string>, group_size bigint, batch_id bigint").parquet(f"{into}/updates")
    last = updates.groupBy("digest").agg(F.max_by(F.struct("first", "group_size"), "batch_id").alias("s"))
    return staging.stage(last.select("digest", "s.*"), "dedup-groups")


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", locator: Column | None = None, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256, locator.

    locator: says where a row's text is, as a string; by default its id and a number of the row. Of rows that share the smallest doc_id
    of their group, the one with the smallest locator is kept. digest: of a normalised text.
    """
    text, spark = normalised(F.col(text_col)), docs.sparkSession
    at = F.concat_ws("#", F.col(id_col).cast("string"), F.monotonically_increasing_id()) if locator is None else locator
    log = staging.stage(docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(text).alias("digest"), at.alias("locator"), sha256(text).alias("text_sha256")), "dedup-log")
    if log.isEmpty():
        return spark.createDataFrame([], "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string, locator string")
    groups = states(log)
    # full bytes of every digest that was hit again
    hits = staging.stage(groups.where("group_size > 1").select("digest"), "dedup-hits")
    texts = docs.select(digest(text).alias("digest"), text.alias("whole"), F.col(id_col).cast("long").alias("doc_id"), at.alias("locator"))
    hit_again = lambda of: texts.join(staging.small(of), "digest", "left_semi")
    collided = staging.stage(hit_again(hits).groupBy("digest", "whole").agg(F.lit(1).alias("one")).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"), "dedup-collided")
    rows = log.select("doc_id", "locator", "digest", "text_sha256")
    if not collided.isEmpty():  # two texts of one digest: by text
        several = staging.stage(hit_again(collided), "dedup-several")
        by_text = several.groupBy("digest", "whole").agg(least_row().alias("first"), F.count(F.lit(1)).alias("group_size"))
        apart = several.join(by_text, ["digest", "whole"]).select("doc_id", "locator", "digest", sha256(F.col("whole")).alias("text_sha256"), "first", "group_size")
        found = rows.join(collided, "digest", "left_anti").join(groups, "digest").select(*apart.columns).unionByName(apart)
    else:
        found = rows.join(groups, "digest")
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & F.col("locator").eqNullSafe(F.col("first.locator"))
    return found.select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256", "locator")


def place_in_file(docs: DataFrame) -> Column:
    """The locator of a row of docs, which are read from files: the file and the row's number in it."""
    meta = docs.metadataColumn("_metadata")  # whatever docs' own columns are called
    return F.concat_ws("#", meta["file_path"], meta["row_index"])


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs, as read from files, without the rows whose places are in gone(locator), which is staged."""
    name = staging.free_name(docs, "locator")
    return docs.withColumn(name, place_in_file(docs)).join(staging.small(gone.withColumnRenamed("locator", name)), name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs, as read from files, without the rows that exact_dedup does not keep."""
    return without(docs, staging.stage(exact_dedup(docs, locator=place_in_file(docs)).where("NOT kept").select("locator"), "dedup-gone"))
