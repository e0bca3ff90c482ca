"""Source divergence audit: how far the words of each source of a language are from those of the others.

Count vectors as CountVectorizer makes them (one vocabulary for each lang, minDF, no end to the vocabulary's size), summed over the
groups as Summarizer sums vectors. CountVectorizer.fit gathers its vocabulary on the driver and sends it to all
executors; here neither the vocabulary nor a vector of its width is ever in one place: tasks index the terms that they meet, hold each document as a sparse
vector over them and add these up, and Spark merges the partial sums by (lang, term). minDF is applied to the merged document counts: sums of
vectors over all terms, restricted to the kept ones, are the sums of the restricted vectors.

Pairs of sources are evaluated sparsely. A term that a source lacks has the one share p0 there, so with
f(p, q) = floor((p - q)^2 / q) the sum over all V kept terms is
V f(p0_i, p0_j) + sum over i's terms of f(p, p0_j) - f(p0_i, p0_j) + sum over j's terms of f(p0_i, q) - f(p0_i, p0_j)
+ sum over shared terms of f(p, q) - f(p, p0_j) - f(p0_i, q) + f(p0_i, p0_j).
The second and third sums need only how many terms of a source have each share; the last one walks the terms that two sources share.

Null text, lang and source count as ''. Texts are read whole; ties of values go to the smaller item in UTF-8; repeated rows count each time. Groups without terms have count 0
everywhere. An empty table gives no rows; without kept terms pairs have value 0. Columns besides text, lang and source are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import staging, text

MIN_DF = 3
#: Ranks of the part `term`.
TERMS = 200
#: Shares are counted in units of 1 / SHARE.
SHARE = 1_000_000_000
#: A lang's sources are dealt to so many tasks where each meets all others.
DEALS = 32
#: A task hands its partial sums on when it holds so many.
HELD = 400_000

#: Bytes other than a-z and those of non-ASCII characters become spaces.
LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_of(raw: bytes) -> list[bytes]:
    """Matches of `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`, A-Z lower-cased."""
    return raw.lower().translate(LETTERS).split()


class GroupSums:
    """The sums of the sparse count vectors of a task's documents, for each (lang, source), and of their supports.

    `index` gives each term met its number, the coordinate of the vectors; sums are kept by (group, coordinate).
    """

    def __init__(self) -> None:
        self.index: dict[bytes, int] = {}
        self.groups: dict[tuple[bytes, bytes], tuple[dict[int, int], dict[int, int]]] = {}
        self.held = 0

    def vector(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """A text's sparse vector: coordinates and counts."""
        index = self.index
        at = np.array([index.setdefault(t, len(index)) for t in terms_of(raw)], np.int64)
        return np.unique(at, return_counts=True)

    def add(self, group: tuple[bytes, bytes], raw: bytes) -> None:
        counts, rows = self.groups.setdefault(group, ({}, {}))
        before = len(counts)
        for at, n in zip(*(x.tolist() for x in self.vector(raw)), strict=True):
            counts[at] = counts.get(at, 0) + n
            rows[at] = rows.get(at, 0) + 1
        self.held += len(counts) - before

    def rows(self) -> Iterator[pa.RecordBatch]:
        """(lang, source, term, count, df) so far; a group's first row has no term."""
        words = list(self.index)
        for (lang, source), (counts, rows) in self.groups.items():
            n = len(counts) + 1
            columns = [[lang] * n, [source] * n, [None, *[words[i] for i in counts]]]
            strings = [pa.array(c, pa.binary()).cast(pa.string()) for c in columns]
            yield pa.RecordBatch.from_arrays([*strings, pa.array([0, *counts.values()], pa.int64()), pa.array([0, *rows.values()], pa.int64())], ["lang", "source", "term", "n", "df"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = GroupSums()
    for batch in batches:
        langs, sources, texts = (text.as_bytes(batch.column(i)) for i in range(3))
        for lang, source, raw in zip(langs, sources, texts, strict=True):
            sums.add((lang, source), raw)
            if sums.held > HELD:
                yield from sums.rows()
                sums = GroupSums()
    yield from sums.rows()


def group_sums(docs: DataFrame, min_df: int = MIN_DF) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, n, lang_n) of the terms that at least min_df of a lang's documents hold, for the sources that have them, and (lang, source) of all groups.

    n counts a term's occurrences in a source, lang_n in the lang. One shuffle, by (lang, term): the sums by source, the document counts and the lang's counts lie together.
    """
    known = docs.select("lang", "source", "text").mapInArrow(_sums, "lang string, source string, term string, n long, df long")
    merged = known.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    of_term = Window.partitionBy("lang", "term")
    counted = merged.select("lang", "source", "term", "n", F.sum("df").over(of_term).alias("df"), F.sum("n").over(of_term).alias("lang_n"))
    counted = staging.stage(counted.where((F.col("df") >= min_df) | F.col("term").isNull()).drop("df"), "divergence-sums")
    return counted.where("term IS NOT NULL"), counted.where("term IS NULL").select("lang", "source")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SHARE * (n + 1) / (total + terms)), in decimals: counts times SHARE outgrow a long."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.lit(1).cast("long") + F.call_function("div", F.lit(SHARE).cast("decimal(10,0)") * wide(n + 1), wide(total + terms))


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _of_slice(terms: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows lo to hi with each row of the same term: their places. terms: where each row's term begins and ends."""
    begins, ends = terms[0, lo:hi], terms[1, lo:hi]
    many = ends - begins
    left = np.repeat(np.arange(lo, hi), many)
    return left, np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begins, many)


def shared_sums(source: np.ndarray, p: np.ndarray, p0: np.ndarray, begins: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes `source << 32 | other source` and sums over the terms that both have. begins: where terms begin in the rows; about `most` pairs at a time."""
    many = np.diff(np.append(begins, len(p)))
    terms = np.repeat(np.stack([begins, begins + many]), many, axis=1)
    done = np.cumsum(terms[1] - terms[0])
    lo = 0
    while lo < len(p):
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + most, side="right")))
        i, j = _of_slice(terms, lo, hi)
        i, j = i[i != j], j[i != j]
        a, za, b, zb = p[i], p0[i], p[j], p0[j]
        f = lambda x, y: (x - y) ** 2 // y
        value, code = f(a, b) - f(a, zb) - f(za, b) + f(za, zb), source[i] << 32 | source[j]
        order = np.argsort(code, kind="stable")
        code = code[order]
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.empty(0, np.int64)
        yield code[first], np.add.reduceat(value[order], first) if len(first) else first
        lo = hi


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, item, value): the sums over shared terms, of rows (lang, term, source, p, p0) sorted by (lang, term)."""
    number: dict[tuple[str, str], int] = {}
    sums: dict[int, int] = {}
    waiting: list[tuple] = []

    def take(rows: list[tuple]) -> None:
        begins = [i for i, r in enumerate(rows) if i == 0 or r[:2] != rows[i - 1][:2]]
        source = np.array([number.setdefault((r[0], r[2]), len(number)) for r in rows], np.int64)
        for codes, values in shared_sums(source, np.array([r[3] for r in rows], np.int64), np.array([r[4] for r in rows], np.int64), np.array(begins, np.int64)):
            for code, value in zip(codes.tolist(), values.tolist(), strict=True):
                sums[code] = sums.get(code, 0) + value

    def out() -> pa.RecordBatch:
        names = list(number)
        sides = [names[c >> 32] for c in sums], [names[c & 0xFFFFFFFF] for c in sums]
        columns = [[s[0] for s in sides[0]], [s[1] for s in sides[0]], [s[1] for s in sides[1]]]
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in columns], pa.array(list(sums.values()), pa.int64())], ["lang", "source", "item", "value"])

    for batch in batches:
        waiting += zip(*(c.to_pylist() for c in batch.columns), strict=True)
        last = len(waiting) - 1
        while last > 0 and waiting[last - 1][:2] == waiting[last][:2]:
            last -= 1
        if last > 0:
            take(waiting[:last])
            waiting = waiting[last:]
        if len(sums) > HELD:
            yield out()
            sums.clear()
    take(waiting)
    yield out()


def divergence(docs: DataFrame, min_df: int = MIN_DF, terms: int = TERMS) -> DataFrame:
    """lang, source, part, item, value and rank: for each source of a lang its distance to each other source (part `pair`), and its `terms` terms that stand out most from the lang (part `term`)."""
    sums, groups = group_sums(docs, min_df)
    sizes = sums.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    vocabulary = sums.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("lang_total"))
    known = groups.join(sizes, ["lang", "source"], "left").join(staging.small(vocabulary), "lang", "left")
    known = known.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"))
    known = known.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.col("v"))))
    known = staging.stage(known, "divergence-groups")

    placed = sums.join(staging.small(known), ["lang", "source"])
    placed = placed.select("lang", "term", "source", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), "p0", share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"))

    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ahead = placed.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    of_terms = ahead.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= terms)

    # every source of a lang meets every other one: dealt, so that a lang is many tasks
    deal = lambda: F.pmod(F.xxhash64("source"), F.lit(DEALS)).cast("int").alias("deal")
    others = known.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), "v", F.explode(F.array(*[F.lit(i) for i in range(DEALS)])).alias("deal"))
    base = known.select("lang", "source", "p0", deal()).join(others, ["lang", "deal"]).where("source <> item")
    f = distance
    p0, q0 = F.col("p0"), F.col("q0")
    whole = base.select("lang", "source", "item", F.coalesce(F.col("v") * f(p0, q0), F.lit(0)).alias("value"))
    shares = placed.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("n"))
    own = shares.withColumn("deal", F.pmod(F.xxhash64("source", "p"), F.lit(DEALS)).cast("int")).join(others, ["lang", "deal"]).where("source <> item")
    both = F.array(
        F.struct(F.col("source"), F.col("item"), (F.col("n") * (f(F.col("p"), q0) - f(p0, q0))).alias("value")),
        F.struct(F.col("item").alias("source"), F.col("source").alias("item"), (F.col("n") * (f(q0, F.col("p")) - f(q0, p0))).alias("value")),
    )
    sides = own.select("lang", F.explode(both).alias("s")).select("lang", "s.*")
    shared = placed.select("lang", "term", "source", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_pairs, "lang string, source string, item string, value long")
    pairs = whole.unionByName(sides).unionByName(shared).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    of_pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(first))
    return of_pairs.unionByName(of_terms)
