"""Exact top-k by inner product, as a Voronoi kNN join.

Vectors are quantised to integers, and each belongs to the cell of its nearest pivot
(pivots: rows picked by hash, about the root of the number of queries). A cell's summary is its k + 1
smallest distances to the pivot, with one row for each vec_id in all cells together, its counts, and quantiles of its distances. For a query q and a vector v of the
cell of pivot p at distance r, q.p - |q| r <= q.v <= q.p + |q| r, so from the
summaries alone

* the (k + 1)-th largest of q.p - |q| r over summarised distances, of which one at most is of
  the query's own id, is a score that the query's k-th best is not below, and
* v can only matter to q if r is at least (bound - q.p) / |q|.

Cells are gathered into groups of queries; a group needs of each cell the vectors from the
smallest such r of its queries on, and only those are sent to it. The number of groups is the one with the least
work by the summaries: many where the bounds prune, one where they don't, so that then each vector is sent once, and only the queries, a small
part of the rows, go to every block of vectors. Each (group,
block of its queries, block of its vectors) is solved by itself, so that a cell which
holds a third of all rows is many tasks; the blocks' top k are then merged.

Rows whose vector is null, or has null, NaN or infinite components, take no part.
Vectors of any finite components do: products are exact whatever their size, and a score beyond a long's range counts as its end.
Shorter vectors count as filled up with zeros. Rows that share the query's id
are not its candidates. Rows of one query id are one query: its answer is the best of the candidates by any of its vectors, identical ones counted once; repeated
candidates count each. Ties go to the smaller vec_id. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import staging

#: Values of this size and more are kept as 64-bit floats, which hold floor(scale * x) exactly.
LARGE = 1 << 31
LAST = (1 << 63) - 1


def quantised(rows: DataFrame, scale: float) -> DataFrame:
    """vec_id, v of the rows that take part: floor(scale * x) in bytes, 32-bit integers after a 4, or 64-bit floats after an 8."""

    def convert(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            ids, out = [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False), strict=True):
                if i is None or x is None or x.dtype == object and any(c is None for c in x):
                    continue
                v = np.floor(scale * np.asarray(x, np.float64))  # a null within numbers is NaN here
                if np.isfinite(v).all():
                    ids.append(i)
                    out.append(b"\4" + v.astype("<i4").tobytes() if (np.abs(v) < LARGE).all() else b"\x08" + v.astype("<f8").tobytes())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["vec_id", "v"])

    return rows.mapInArrow(convert, "vec_id long, v binary")


def matrix(values: list[bytes], width: int) -> np.ndarray:
    """The vectors as rows of width columns."""
    if all(v[0] == 4 and len(v) == 4 * width + 1 for v in values):
        return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), 4 * width + 1)[:, 1:].copy().view("<i4").astype(np.float64)
    out = np.zeros((len(values), width))
    for row, v in zip(out, values, strict=True):
        own = np.frombuffer(v, "<i4" if v[0] == 4 else "<f8", offset=1)
        row[: len(own)] = own
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point only while every sum is below 2**53; those beyond a long as its ends."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    if most < 2**62 and max(np.abs(a).max(), np.abs(b).max()) < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = [[[int(x) for x in row] for row in side] for side in (a, b)]
    sums = [[sum(x * y for x, y in zip(r, c, strict=True)) for c in whole[1]] for r in whole[0]]
    return np.array([[max(-LAST - 1, min(LAST, x)) for x in row] for row in sums], np.int64).reshape(len(a), len(b))


def bounds(q: np.ndarray, pivots: np.ndarray, nearest: np.ndarray, k: int) -> np.ndarray:
    """For each query and cell, the distance to the pivot from which on a vector can matter. nearest: smallest distances by cell, inf where there are fewer."""
    dot, norm = q @ pivots.T, np.linalg.norm(q, axis=1)[:, None]
    lower = (dot[:, :, None] - norm[:, :, None] * nearest[None]).reshape(len(q), -1)
    lower = np.nan_to_num(lower, nan=-np.inf)  # |q| = 0 and no such vector
    at = lower.shape[1] - min(k + 1, lower.shape[1])
    bound = np.partition(lower, at, axis=1)[:, at][:, None] if lower.shape[1] > k else np.full((len(q), 1), -np.inf)
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(norm > 0, (bound - dot) / norm, -np.inf)
    size = np.abs(np.where(np.isfinite(need), need, 0)) + np.linalg.norm(pivots, axis=1)[None]
    return need - 1e-6 * (1 + np.abs(np.where(np.isfinite(need), need, 0))) - 1e-12 * size  # rounding must not lose a tie


def gather(pivots: np.ndarray, counts: np.ndarray, groups: int) -> np.ndarray:
    """The group of each cell: cells in a chain of near neighbours, cut into runs with like numbers of queries."""
    left, chain = set(range(1, len(pivots))), [0]
    while left:
        rest = sorted(left)
        chain.append(rest[int(np.argmin(((pivots[rest] - pivots[chain[-1]]) ** 2).sum(axis=1)))])
        left.remove(chain[-1])
    done, total, out = 0, max(1, counts.sum()), np.zeros(len(pivots), int)
    for c in chain:
        out[c] = min(groups - 1, int(done * groups / total))
        done += counts[c]
    return out


def grouping(pivots: np.ndarray, counts: np.ndarray, far: np.ndarray, vectors: np.ndarray, need: np.ndarray, send: float = 100.0) -> np.ndarray:
    """The groups of cells with the least work, in products: a vector that is sent counts as `send`.

    counts, vectors: queries and vectors of each cell. far: quantiles of a cell's distances, a row each. need: from which distance on queries of a cell (row) need another's vectors.
    """
    tried, n = [], 1
    while n <= len(pivots):
        group = gather(pivots, counts, n)
        sent = np.array([((far >= need[group == g].min(axis=0)[:, None]).mean(axis=1) * vectors).sum() if (group == g).any() else 0.0 for g in range(n)])
        tried.append(((sent * (np.bincount(group, counts, n) + send)).sum(), n, group))
        n *= 2
    return min(tried, key=lambda t: t[:2])[2]


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to the smaller id. ids ascend."""
    if len(scores) <= k:
        found = np.arange(len(scores))
    else:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        over = np.flatnonzero(scores > least)
        found = np.append(over, np.flatnonzero(scores == least)[: k - len(over)])
    return found[np.lexsort((ids[found], -scores[found]))]


def split(ids: np.ndarray, data: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors of small components, then the others; neither if there are none."""
    large = np.abs(data).max(axis=1, initial=0) >= 1 << 22
    return [(ids[of], data[of]) for of in (~large, large) if of.any()]


def solver(k: int, width: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The k best vectors of a block for each query of a block."""

    def solve(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(queries) and len(vectors):
            vectors = vectors.sort_values("vec_id", kind="stable")
            # the few large ones, whose products are costly, apart from the others
            sides = [split(x["vec_id"].to_numpy(), matrix(x["v"].tolist(), width)) for x in (queries, vectors)]
            for (qs, q_data), (ids, data) in ((q, v) for q in sides[0] for v in sides[1]):
                for lo in range(0, len(qs), 64):
                    for q, row in zip(qs[lo : lo + 64], products(q_data[lo : lo + 64], data), strict=True):
                        other = ids != q
                        own, row = (ids[other], row[other]) if not other.all() else (ids, row)
                        out += [(int(q), int(own[i]), int(row[i])) for i in best(row, own, k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return solve


def top_k(rows: DataFrame, k: int = 5, *, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, n_pivots: int | None = None, queries_per_group: int = 16384, block: int = 32768) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row whose id is divisible by `every`.

    block: vectors in one task at a time; a task also holds at most about 2 * queries_per_group queries. n_pivots: by default the root of the number of queries, from 16 to 256.
    """
    spark = rows.sparkSession
    out = "query_id long, rank int, vec_id long, score long"
    plain = staging.stage(quantised(rows.select(F.col(id_col).cast("long"), F.col(vector_col)), scale), "knn-vectors")
    at = (F.col("vec_id") % every) == 0
    size = plain.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(at, 1)).alias("q")).first()
    if not size["q"]:
        return spark.createDataFrame([], out)
    width = plain.agg(F.max(F.expr("(octet_length(v) - 1) / IF(hex(substring(v, 1, 1)) = '04', 4, 8)"))).first()[0]
    width, n_pivots = int(width), n_pivots or min(256, max(16, math.isqrt(size["q"])))
    picked = plain.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(n_pivots).collect()  # n_pivots rows
    pivots = np.unique(matrix([bytes(r["v"]) for r in picked], width), axis=0) if width else np.zeros((1, 0))

    def assign(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            x = matrix(batch.column("v").to_pylist(), width)
            square = np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(axis=1)[None], 0)
            cell = square.argmin(axis=1).astype(np.int32)
            far = np.linalg.norm(x - pivots[cell], axis=1)
            yield pa.record_batch([*batch.columns, pa.array(cell), pa.array(far)], ["vec_id", "v", "cell", "far"])

    placed = staging.stage(plain.mapInArrow(assign, "vec_id long, v binary, cell int, far double"), "knn-cells")
    # summaries: k + 1 distances, of different vec_ids, and two counts for each cell
    nearest_rows = placed.groupBy("vec_id").agg(F.min(F.struct("far", "cell")).alias("s")).select("s.*")
    ranked = nearest_rows.withColumn("i", F.row_number().over(Window.partitionBy("cell").orderBy("far"))).where(F.col("i") <= k + 1)
    nearest = np.full((len(pivots), k + 1), np.inf)
    for r in ranked.collect():
        nearest[r["cell"], r["i"] - 1] = r["far"]
    counts = np.zeros(len(pivots), int)
    for r in placed.where(at).groupBy("cell").agg(F.count(F.lit(1)).alias("q")).collect():
        counts[r["cell"]] = r["q"]
    far, vectors = np.full((len(pivots), 17), -np.inf), np.zeros(len(pivots))
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("far", [i / 16 for i in range(17)], 200).alias("far")).collect():
        far[r["cell"]], vectors[r["cell"]] = r["far"], r["n"]

    def needs(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.full((len(pivots), len(pivots)), np.inf)
        for batch in them:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                np.minimum.at(least, part.column("cell").to_numpy(), bounds(matrix(part.column("v").to_pylist(), width), pivots, nearest, k))
        g, c = np.nonzero(least < np.inf)
        yield pa.record_batch([pa.array(g, pa.int32()), pa.array(c, pa.int32()), pa.array(least[g, c])], ["own", "cell", "need"])

    by_cell = np.full((len(pivots), len(pivots)), np.inf)
    for r in placed.where(at).mapInArrow(needs, "own int, cell int, need double").groupBy("own", "cell").agg(F.min("need").alias("need")).collect():
        by_cell[r["own"], r["cell"]] = r["need"]  # n_pivots squared at most
    group_of = grouping(pivots, counts, far, vectors, by_cell)
    n_groups = int(group_of.max()) + 1
    need = np.array([by_cell[group_of == g].min(axis=0, initial=np.inf) for g in range(n_groups)])

    def send(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            g, i = np.nonzero(batch.column("far").to_numpy()[None] >= need[:, batch.column("cell").to_numpy()])
            if len(i):
                yield pa.record_batch([batch.column("vec_id").take(pa.array(i)), batch.column("v").take(pa.array(i)), pa.array(g, pa.int32())], ["vec_id", "v", "g"])

    sent = placed.mapInArrow(send, "vec_id long, v binary, g int")
    blocks = {r["g"]: math.ceil(r["n"] / block) for r in sent.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    per_group = np.bincount(group_of, counts, n_groups)
    table = spark.createDataFrame([(g, blocks.get(g, 1), max(1, math.ceil(per_group[g] / queries_per_group / 2))) for g in range(n_groups)], "g int, v_blocks int, q_blocks int")
    cells = spark.createDataFrame([(c, int(g)) for c, g in enumerate(group_of)], "cell int, g int")
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # both tables have n_pivots rows at most
    queries = placed.where(at).select("vec_id", "v", "cell").distinct().join(F.broadcast(cells), "cell").join(F.broadcast(table), "g")
    queries = queries.select("vec_id", "v", "g", dealt("q_blocks").alias("qb"), each("v_blocks").alias("vb"))
    vectors = sent.join(F.broadcast(table), "g").select("vec_id", "v", "g", dealt("v_blocks").alias("vb"), each("q_blocks").alias("qb"))
    solved = queries.groupBy("g", "qb", "vb").cogroup(vectors.groupBy("g", "qb", "vb")).applyInPandas(solver(k, width), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return solved.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
