"""Shards of near-equal bytes by Karmarkar-Karp differencing.

Rows of equal text form a group that is never divided. Groups larger than
1/parcels of all bytes (so fewer than `parcels`) are items of their own; the other
groups fall by hash into `parcels` parcels, which are items too. The differencing
therefore handles at most 2 * parcels items, whatever the size of the input.
Where one group is larger than a shard's share, its shard is too.

Null texts count as empty and are one group with empty texts; an empty table
gives an empty result; repeated rows get slots of their own. Rows are told apart by numbers they get when they are read, so that
rows that share an id, or have none, are numbered in many tasks; a shard's slots follow these numbers, its rows do not.
Texts are read whole, however long; other columns aren't read, whatever they are called.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import staging

#: A row's fixed cost in bytes besides its text.
ROW_BYTES = 16


def difference(weights: list[int], k: int) -> list[int]:
    """The part, 0 to k - 1, of each weight.

    A partial partition is k sums with what each holds. The two of largest spread are
    combined again and again, the largest sum of one with the smallest of the other.
    """
    heap = [(-w, i, [(w, (i, None))] + [(0, None)] * (k - 1)) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    serial = len(weights)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        # both are kept in descending order of their sums
        both = sorted(((x[0] + y[0], x[1] if y[1] is None else y[1] if x[1] is None else (x[1], y[1])) for x, y in zip(a, reversed(b), strict=True)), key=lambda p: -p[0])
        least = both[-1][0]
        heapq.heappush(heap, (least - both[0][0], serial, [(s - least, held) for s, held in both]))
        serial += 1
    part = [0] * len(weights)
    for shard, (_, held) in enumerate(heap[0][2] if heap else []):
        todo = [held] if held is not None else []
        while todo:
            left, right = todo.pop()
            if right is None and isinstance(left, int):
                part[left] = shard
            else:
                todo += [left, right]
    return part


def shard_rows(docs: DataFrame, n_shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text", parcels: int = 10240, cells: int = 1024) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of docs.

    cells: the parts of a shard whose rows are numbered apart, so that no task numbers a whole shard.
    """
    spark, text = docs.sparkSession, F.coalesce(F.col(text_col), F.lit(""))
    rows = staging.stage(docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key"), F.monotonically_increasing_id().alias("at")), "shard-rows")
    groups = staging.stage(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "shard-groups")
    unit = (groups.agg(F.sum("bytes")).first()[0] or 0) / parcels
    big = [(r["key"], r["bytes"]) for r in groups.where(F.col("bytes") > unit).collect()]  # under `parcels` rows
    rest = groups.where(F.col("bytes") <= unit).groupBy(F.pmod("key", F.lit(parcels)).cast("int").alias("parcel")).agg(F.sum("bytes").alias("bytes"))
    lots = [(r["parcel"], r["bytes"]) for r in rest.collect()]  # at most `parcels` rows
    items = sorted([*((b, 0, k) for k, b in big), *((b, 1, p) for p, b in lots)], key=lambda x: (-x[0], x[1], x[2]))
    part = difference([x[0] for x in items], n_shards)
    of_key = spark.createDataFrame([(x[2], s) for x, s in zip(items, part, strict=True) if x[1] == 0], "key long, own_shard int")
    of_parcel = spark.createDataFrame([(x[2], s) for x, s in zip(items, part, strict=True) if x[1] == 1], "parcel int, lot_shard int")
    # the three tables have at most parcels, parcels and n_shards * cells rows
    placed = (
        rows.withColumn("parcel", F.pmod("key", F.lit(parcels)).cast("int"))
        .join(F.broadcast(of_key), "key", "left")
        .join(F.broadcast(of_parcel), "parcel", "left")
        .select("doc_id", "size", "text_crc32", F.coalesce("own_shard", "lot_shard").alias("shard"), "at", F.pmod(F.xxhash64("at"), F.lit(cells)).cast("int").alias("cell"))
    )
    in_order = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n")).select("shard", "cell", F.coalesce(F.sum("n").over(in_order), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size", "at")
    return (
        placed.withColumn("rank", F.row_number().over(within))
        .join(F.broadcast(starts), ["shard", "cell"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast(T.IntegerType()).alias("grown_shard"))
    )
