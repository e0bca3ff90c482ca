"""Mixing sources to target weights by fitting a subset sum to each budget.

Documents are counted by source and exact length. A source whose target is over
its size is taken whole as often as it fits; the remaining budget is filled by
taking of each length its share (rounded down), then single documents by
descending length, and the last `dp_words` words by a bounded knapsack over
lengths. Which documents of a length are taken follows a seeded hash, so runs
agree. Ranking works within (source, length, hash cell), and a length that holds
a third of all rows is spread over `cells` cells.

Null texts count as empty; texts without words are taken as often as the
others but add nothing; an empty table gives an empty result; repeated rows count
each. The number of sources is assumed to fit on the driver (a name and a total
each); counts by length never go there.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import staging

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = 1.0, most: float = 3.0) -> list[float]:
    """Each source's target: its weight's part of share * all sizes, at most `most` times its size; the excess goes to the others by weight."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while free:
        total = sum(weights[i] for i in sorted(free))
        over = [i for i in sorted(free) if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        free -= set(over)
    return out


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length (at most counts) to take so that the sum comes as near to budget as it can from below.

    Bit s of `reach` says that a sum of s can be made; counts are split into powers of two.
    """
    parts, reach, full = [], 1, (1 << (budget + 1)) - 1
    for i, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        n, step = min(count, budget // length), 1
        while n > 0:
            step = min(step, n)
            parts.append((i, step, reach))
            reach = (reach | reach << (length * step)) & full
            n, step = n - step, step * 2
        if reach >> budget & 1:
            break
    at, taken = reach.bit_length() - 1, [0] * len(lengths)
    for i, step, before in reversed(parts):
        if not before >> at & 1:
            taken[i] += step
            at -= lengths[i] * step
    return taken


def fit(lengths: list[int], counts: list[int], budget: int, dp_words: int = 1 << 16) -> list[int]:
    """How many documents of each length make a sum near budget (at most sum(lengths * counts))."""
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if not total:
        return [0] * len(lengths)
    budget = max(0, min(budget, total))
    taken = [c * budget // total for c in counts]
    left = budget - sum(n * t for n, t in zip(lengths, taken, strict=True))
    order = sorted((i for i in range(len(lengths)) if lengths[i]), key=lambda i: -lengths[i])
    moved = True
    while left > dp_words and moved:
        moved = False
        for i in order:
            if left <= dp_words:
                break
            if taken[i] < counts[i] and lengths[i] <= left:
                taken[i] += 1
                left -= lengths[i]
                moved = True
    fits = [i for i in order if lengths[i] <= left and taken[i] < counts[i]]
    for i, n in zip(fits, knapsack([lengths[i] for i in fits], [counts[i] - taken[i] for i in fits], left), strict=True):
        taken[i] += n
    return taken


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), *, share: float = 1.0, most: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cells: int = 256, dp_words: int = 1 << 16, locator: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, repeats of each row of docs.

    Sources in order of code points, null last, get the weights in turn. repeats: how often the mix has the row; taken: repeats * size.
    locator: says where a row is, as a string; if given, it is a column of the result, and tells apart rows of one id, or of none.
    """
    spark = docs.sparkSession
    id_, seeded = F.col(id_col).cast("long"), F.xxhash64(F.lit(seed), F.col(id_col).cast("long"))
    place = [] if locator is None else ["locator"]
    if place:
        seeded = F.when(id_.isNull(), F.xxhash64(F.lit(seed), locator)).otherwise(seeded)
    rows = staging.stage(docs.select(id_.alias("doc_id"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.col(source_col).alias("source"), seeded.alias("h"), *([] if locator is None else [locator.alias("locator")])), "mix-rows")
    sizes = sorted(((r["source"], r["s"]) for r in rows.groupBy("source").agg(F.sum("size").alias("s")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    wanted = targets([s for _, s in sizes], [weights[i % len(weights)] for i in range(len(sizes))], share, most)
    plan = {}
    for sid, ((_, size), target) in enumerate(zip(sizes, wanted, strict=True)):
        epochs = min(most, math.floor(target / size + 1e-12)) if size else 0
        plan[sid] = (epochs, max(0, round(target - epochs * size)) if epochs < most else 0)
    # from Arrow, so that the rows are in the plan: those of a list come from Python workers of another kind, which stay beside SQL's own
    columns = {"sid": pa.array(range(len(sizes)), pa.int32()), "name": pa.array([name for name, _ in sizes], pa.string()), "source_size": pa.array([size for _, size in sizes], pa.int64()), "target": pa.array(wanted, pa.float64()), "epochs": pa.array([plan[sid][0] for sid in range(len(sizes))], pa.int32())}
    sources = F.broadcast(spark.createDataFrame(pa.table(columns)))
    rows = rows.join(sources, rows["source"].eqNullSafe(sources["name"])).withColumn("cell", F.pmod("h", F.lit(cells)).cast("int"))

    def choose(counts: pd.DataFrame) -> pd.DataFrame:
        counts = counts.sort_values("size")
        taken = fit(counts["size"].tolist(), counts["n"].tolist(), plan[int(counts["sid"].iloc[0])][1], dp_words)
        return pd.DataFrame({"sid": counts["sid"], "size": counts["size"], "take": taken})

    lengths = rows.groupBy("sid", "size").agg(F.count(F.lit(1)).alias("n"))
    chosen = lengths.groupBy("sid").applyInPandas(choose, "sid int, size long, take long").where("take > 0")
    before = Window.partitionBy("sid", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    in_cell = rows.groupBy("sid", "size", "cell").agg(F.count(F.lit(1)).alias("n")).join(chosen, ["sid", "size"])
    in_cell = in_cell.withColumn("cell_take", F.col("take") - F.coalesce(F.sum("n").over(before), F.lit(0))).where("cell_take > 0").select("sid", "size", "cell", "cell_take")
    rank = F.row_number().over(Window.partitionBy("sid", "size", "cell").orderBy("h", "doc_id", *place))
    repeats = (F.col("epochs") + F.when(F.col("rank") <= F.coalesce("cell_take", F.lit(0)), 1).otherwise(0)).cast("int")
    return (
        rows.join(in_cell, ["sid", "size", "cell"], "left")
        .withColumn("rank", rank)
        .select("doc_id", "size", "source_size", "target", (repeats * F.col("size")).cast("long").alias("taken"), "source", repeats.alias("repeats"), *place)
    )


def apply(docs: DataFrame, mixed: DataFrame, locator: Column) -> DataFrame:
    """docs, each row as often as mixed, of mix with that locator, says."""
    name = "mix_locator"
    while any(c.lower().startswith(name) for c in docs.columns):
        name = f"_{name}"
    times = mixed.where("repeats > 0").select(F.col("locator").alias(name), F.col("repeats").alias(f"{name}_repeats"))
    met = docs.withColumn(name, locator).join(staging.small(staging.stage(times, "mix-times")), name)
    return met.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(f"{name}_repeats"))).alias(f"{name}_copy")).select(*[F.col(f"`{c}`") for c in docs.columns])
