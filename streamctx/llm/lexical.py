"""Ranked lexical search over bit-sliced Bloom signatures.

`build_index` reads every text once and gives each document a Bloom signature of its terms and of how often they occur: a
term that occurs tf times is entered once for each level of LEVELS up to tf. Signatures of documents of
like size lie together in blocks, bit by bit: a block is one bitmap of documents for each bit of the signature. ANDing the rows of a term and level gives the
documents that may hold it so often, and never misses one. `search` sums, for each query, the largest score that each term can have at the
level found: an upper bound for every document. The documents with the best bounds are scored exactly, which gives each query's
k-th score so far; then all documents whose bound reaches that score are scored exactly from their whole texts. None is left out that isn't provably below.

Of copies (equal SHA-256 of the text) in a block, a query needs only the k with the least ids, as their scores are equal. Document frequencies are counted over all documents,
by 64-bit hashes of terms. The index grows with the corpus and is stored as a table; queries are taken in blocks of
bounded size, and are all that tasks are sent.

Null and empty texts have no terms: they aren't counted and never found; a query without terms has no results. Texts are read whole, however
long: a signature is as wide as its document needs. Equal scores go to the smaller doc_id; null ids come last; rows that
repeat an id or a text are found each, told apart by their place in files. Columns besides the id and the text are not read, whatever their names. An empty corpus or no queries give no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import dedup, staging, text

#: How often a term occurs, in steps: exact up to 4, then in steps of about a third.
LEVELS = np.array([1, 2, 3, *[x << i for i in range(40) for x in (4, 6)]], np.int64)
#: Rows of a signature for each entry, and bits of width for each entry: at least 12, up to twice that.
ROWS, BITS = 4, 12
#: Documents in a block, and the bytes of its bitmaps; blocks of wide signatures have fewer documents, but 8 at least.
BLOCK, BLOCK_BYTES = 1024, 2 << 20
#: A task hands its document frequencies on when it holds so many terms.
HELD = 200_000
#: Queries of a block, and bytes of their texts.
QUERIES, QUERY_BYTES = 2_000, 4 << 20
#: Documents scored first for each query.
SEEDS = 32

INDEX = "width int, docs long, terms long, rows binary, sizes binary, ids array<long>, places array<string>, digests array<binary>, words binary, df binary"


def terms_of(raw: bytes) -> Counter:
    """How often each match of `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+` occurs, A-Z lower-cased."""
    return Counter(text.plain_words(raw))


def hashed(term: bytes) -> int:
    return xxhash.xxh3_64_intdigest(term)


def entries(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The hash of each (term, level)."""
    return text._mixed(hashes + (levels.astype(np.uint64) + np.uint64(1)) * text._MUL[0])


def bits_of(entry: np.ndarray, width: int) -> np.ndarray:
    """The ROWS bits of each entry in a signature of that width, a power of two."""
    low, high = entry & np.uint64(0xFFFFFFFF), entry >> np.uint64(32) | np.uint64(1)
    return ((low[:, None] + np.arange(ROWS, dtype=np.uint64) * high[:, None]) & np.uint64(width - 1)).astype(np.int64)


def of_document(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A document's entries: each term once for each level that it reaches."""
    many = np.searchsorted(LEVELS, counts, side="right")
    level = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return entries(np.repeat(hashes, many), level)


class Block:
    """Signatures of one width, bit by bit."""

    def __init__(self, width: int) -> None:
        self.width, self.room = width, max(8, min(BLOCK, 8 * BLOCK_BYTES // width))
        self.rows = np.zeros((width, self.room // 8), np.uint8)
        self.about: list[tuple] = []

    def add(self, entry: np.ndarray, about: tuple) -> bool:
        """Whether the block is full now. about: terms, id, place and digest."""
        at = len(self.about)
        self.rows[bits_of(entry, self.width).ravel(), at >> 3] |= np.uint8(0x80 >> (at & 7))
        self.about.append(about)
        return len(self.about) == self.room

    def row(self) -> dict:
        sizes, ids, places, digests = zip(*self.about, strict=True)
        used = np.ascontiguousarray(self.rows[:, : (len(sizes) + 7) // 8])
        return {"width": self.width, "docs": len(sizes), "terms": sum(sizes), "rows": used.tobytes(), "sizes": np.array(sizes, np.int64).tobytes(), "ids": ids, "places": places, "digests": digests, "words": None, "df": None}


def _frequencies(df: Counter) -> dict:
    words = np.fromiter(df, np.uint64, len(df))
    return dict.fromkeys(("docs", "terms", "rows", "sizes", "ids", "places", "digests")) | {"width": 0, "words": words.tobytes(), "df": np.fromiter(df.values(), np.int64, len(df)).tobytes()}


_INDEX_TYPE = pa.schema([("width", pa.int32()), ("docs", pa.int64()), ("terms", pa.int64()), ("rows", pa.binary()), ("sizes", pa.binary()), ("ids", pa.list_(pa.int64())), ("places", pa.list_(pa.string())), ("digests", pa.list_(pa.binary())), ("words", pa.binary()), ("df", pa.binary())])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = lambda row: pa.RecordBatch.from_pylist([row], schema=_INDEX_TYPE)
    memo, blocks, df = text.Memo(hashed), {}, Counter()
    for batch in batches:
        for doc_id, place, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text.as_bytes(batch.column(2)), strict=True):
            found = terms_of(raw)
            if not found:
                continue
            own = [memo[t] for t in found]
            df.update(own)
            entry = of_document(np.array(own, np.uint64), np.fromiter(found.values(), np.int64, len(own)))
            width = 1 << max(8, (BITS * len(entry) - 1).bit_length())
            block = blocks.get(width) or blocks.setdefault(width, Block(width))
            if block.add(entry, (found.total(), doc_id, place, hashlib.sha256(raw).digest())):
                yield out(blocks.pop(width).row())
            if len(df) > HELD:
                yield out(_frequencies(df))
                df.clear()
    for block in blocks.values():
        yield out(block.row())
    if df:
        yield out(_frequencies(df))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The blocks of signatures of all documents (read from files), and the document frequencies of their terms: a staged table, made in one pass without a shuffle."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), dedup.place_in_file(docs).alias("place"), F.col(f"`{text_col}`").alias("text"))
    return staging.stage(rows.mapInArrow(_index, INDEX), "lexical-index")


@dataclass
class Batch:
    """Queries, the corpus's counts, and the terms' weights."""

    keys: list
    of_query: list[np.ndarray]
    words: list[bytes]
    hashes: np.ndarray
    docs: int = 0
    terms: int = 0
    weight: np.ndarray | None = None

    @classmethod
    def of(cls, queries: Sequence[tuple[object, bytes]]) -> Batch:
        number: dict[bytes, int] = {}
        lists = [np.array(sorted(number.setdefault(t, len(number)) for t in terms_of(raw)), np.int64) for _, raw in queries]
        words = list(number)
        return cls([key for key, _ in queries], lists, words, np.array([hashed(w) for w in words], np.uint64))

    def weigh(self, docs: int, terms: int, df: dict[int, int]) -> None:
        self.docs, self.terms = docs, terms
        self.weight = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * df.get(int(h), 0) + 1))) for h in self.hashes], np.int64)

    def lengths(self, sizes: Sequence[int]) -> np.ndarray:
        """m of documents of so many terms."""
        return np.array([10 + 90 * n * self.docs // self.terms for n in sizes], np.int64)

    def bounds(self, row: dict) -> np.ndarray:
        """(queries, documents): no score of a block's documents is above its bound."""
        sizes = np.frombuffer(row["sizes"], np.int64)
        grid = np.frombuffer(row["rows"], np.uint8).reshape(row["width"], -1)
        reached = np.zeros((len(self.words), len(sizes)), np.uint8)
        alive, held = np.arange(len(self.words)), None
        for level in range(len(LEVELS)):
            hit = np.bitwise_and.reduce(grid[bits_of(entries(self.hashes[alive], np.full(len(alive), level)), row["width"])], axis=1)
            held = hit if held is None else held & hit
            some = held.any(axis=1)
            alive, held = alive[some], held[some]
            if not len(alive):
                break
            reached[alive] += np.unpackbits(held, axis=1, count=len(sizes))
        top = int(reached.max(initial=0))
        m = self.lengths(sizes.tolist())
        most = np.zeros((top + 1, len(sizes)), np.int64)  # the largest score of a term of weight 1 at each level
        for level in range(1, top + 1):
            tf = np.minimum(LEVELS[level] - 1 if level < len(LEVELS) else np.iinfo(np.int32).max, sizes)
            most[level] = 1_000_000_000 * tf // (1000 * tf + 8 * m)
        out = np.zeros((len(self.keys), len(sizes)), np.int64)
        column = np.arange(len(sizes))
        for q, own in enumerate(self.of_query):
            if len(own):
                out[q] = (most[reached[own], column] * self.weight[own, None]).sum(axis=0)
        return out

    def scores(self, raw: bytes, queries: Sequence[int]) -> list[int]:
        """The exact scores of a text."""
        found = terms_of(raw)
        m = 10 + 90 * found.total() * self.docs // self.terms
        out = []
        for q in queries:
            tfs = [(found.get(self.words[t], 0), int(self.weight[t])) for t in self.of_query[q].tolist()]
            out.append(sum(w * (1_000_000_000 * tf // (1000 * tf + 8 * m)) for tf, w in tfs if tf))
        return out


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _first(batch: Batch, seeds: int) -> Callable:
    """For mapInArrow: of a task's documents, the `seeds` with the largest bounds for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, where = np.zeros((len(batch.keys), 0), np.int64), np.zeros((len(batch.keys), 0), object)
        for row in _rows_of(batches):
            bounds = batch.bounds(row)
            best = np.concatenate([best, bounds], axis=1)
            where = np.concatenate([where, np.broadcast_to(np.array(row["places"], object), bounds.shape)], axis=1)
            if best.shape[1] > seeds:
                keep = np.argpartition(-best, seeds - 1, axis=1)[:, :seeds]
                best, where = np.take_along_axis(best, keep, 1), np.take_along_axis(where, keep, 1)
        q, i = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(where[q, i].tolist(), pa.string()), pa.array(best[q, i], pa.int64())], ["query", "place", "bound"])

    return run


def _reaching(batch: Batch, least: np.ndarray, k: int) -> Callable:
    """For mapInArrow: (query, place) of the documents whose bound reaches the query's score; of copies in a block, the k of the least ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            q, d = np.nonzero(batch.bounds(row) >= least[:, None])
            places, copies, of = row["places"], Counter(), []
            order = {doc: i for i, doc in enumerate(sorted(set(d.tolist()), key=lambda x: (row["ids"][x] is None, row["ids"][x], places[x])))}
            for query, doc in sorted(zip(q.tolist(), d.tolist(), strict=True), key=lambda x: order[x[1]]):
                copies[query, row["digests"][doc]] += 1
                if copies[query, row["digests"][doc]] <= k:
                    of.append((query, places[doc]))
            if of:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in of], pa.int32()), pa.array([x for _, x in of], pa.string())], ["query", "place"])

    return run


def _scored(batch: Batch, k: int) -> Callable:
    """For mapInArrow: exact scores of (id, place, text, queries), of which a task hands the k best of each query on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        for b in batches:
            for doc_id, place, raw, queries in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), text.as_bytes(b.column(2)), b.column(3).to_pylist(), strict=True):
                for q, score in zip(queries, batch.scores(raw, queries), strict=True):
                    if score > 0:
                        best.setdefault(q, []).append((-score, doc_id is None, doc_id or 0, place))
            best = {q: heapq.nsmallest(k, rows) for q, rows in best.items()}
        rows = [(q, None if r[1] else r[2], r[3], -r[0]) for q, them in best.items() for r in them]
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["query", "doc_id", "place", "score"])

    return run


def _exact(docs: DataFrame, wanted: DataFrame, batch: Batch, k: int, id_col: str, text_col: str) -> DataFrame:
    """(query, doc_id, place, score, rank) of the k best of the wanted (query, place)."""
    by_place = wanted.groupBy("place").agg(F.collect_set("query").alias("queries"))
    by_place = staging.stage(by_place, "lexical-wanted")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), dedup.place_in_file(docs).alias("place"), F.col(f"`{text_col}`").alias("text"))
    found = rows.join(staging.small(by_place), "place").select("id", "place", "text", "queries")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "place")
    scored = found.mapInArrow(_scored(batch, k), "query int, doc_id long, place string, score long")
    return staging.stage(scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "lexical-scored")


def query_blocks(items: DataFrame, key_col: str, text_col: str) -> Iterator[list[tuple[object, bytes]]]:
    """The queries, partition by partition, in lists of at most QUERIES and about QUERY_BYTES."""
    block, size = [], 0
    for row in items.select(F.col(f"`{key_col}`"), F.col(f"`{text_col}`")).toLocalIterator():
        raw = (row[1] or "").encode()
        if block and (len(block) == QUERIES or size + len(raw) > QUERY_BYTES):
            yield block
            block, size = [], 0
        block.append((row[0], raw))
        size += len(raw)
    if block:
        yield block


def search(docs: DataFrame, index: DataFrame, items: DataFrame, k: int = 10, *, key_col: str = "item_id", item_text: str = "text", id_col: str = "doc_id", text_col: str = "text", seeds: int = SEEDS) -> DataFrame:
    """key_col, rank, doc_id and score of the k best documents of each query with a score above 0. index: build_index of the same docs."""
    spark = docs.sparkSession
    docs_n, terms_n = (x or 0 for x in index.where("width > 0").agg(F.sum("docs"), F.sum("terms")).first())
    results = []
    for block in query_blocks(items, key_col, item_text):
        batch = Batch.of(block)
        if not docs_n or not batch.words:
            continue
        asked = np.sort(batch.hashes)

        def counted(batches: Iterator[pa.RecordBatch], asked: np.ndarray = asked) -> Iterator[pa.RecordBatch]:
            for row in _rows_of(batches):
                words, df = np.frombuffer(row["words"], np.uint64), np.frombuffer(row["df"], np.int64)
                mine = np.isin(words, asked)
                yield pa.RecordBatch.from_arrays([pa.array(words[mine].view(np.int64)), pa.array(df[mine])], ["word", "df"])

        frequencies = index.where("width = 0").select("words", "df").mapInArrow(counted, "word long, df long").groupBy("word").agg(F.sum("df").alias("df"))
        blocks = index.where("width > 0").select("width", "rows", "sizes", "ids", "places", "digests")
        with staging.narrow_batches(spark):
            batch.weigh(docs_n, terms_n, {r.word & (1 << 64) - 1: r.df for r in frequencies.collect()})  # as many rows as a block of queries has terms
        best = Window.partitionBy("query").orderBy(F.desc("bound"), "place")
        first = staging.stage(blocks.mapInArrow(_first(batch, seeds), "query int, place string, bound long").withColumn("n", F.row_number().over(best)).where(F.col("n") <= seeds).select("query", "place"), "lexical-first")
        seen = _exact(docs, first, batch, k, id_col, text_col)
        least = np.ones(len(batch.keys), np.int64)
        for r in seen.where(F.col("rank") == k).select("query", "score").collect():  # a row for each query of the block
            least[r.query] = r.score
        reaching = staging.stage(blocks.mapInArrow(_reaching(batch, least, k), "query int, place string"), "lexical-reaching")
        keys = spark.createDataFrame([(i, key) for i, key in enumerate(batch.keys)], f"query int, `{key_col}` {items.schema[key_col].dataType.simpleString()}")
        results.append(_exact(docs, reaching, batch, k, id_col, text_col).join(F.broadcast(keys), "query").select(key_col, "rank", "doc_id", "score"))
        staging.drop(first, seen, reaching)
    if not results:
        return spark.createDataFrame([], f"`{key_col}` {items.schema[key_col].dataType.simpleString()}, rank int, doc_id long, score long")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out
