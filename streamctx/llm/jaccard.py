"""Exact n-gram Jaccard self-join with signature trees, and its components.

A document's set is its distinct 5-word shingles as 64-bit hashes. Two sets link when
100 * shared >= 75 * union. Equal sets are one node. Then

1. Every set sends the first n - ceil(0.75 n) + 1 of its shingles, in one order for all
   sets (often seen ones last), to those shingles' groups. Two linked sets meet in a group.
   This is exact, whatever the order. Of two linked sets the smaller one has at least 6/7 of its shingles
   from their first shared one on: there it leads, and a group without a leading member is left out. Of
   groups with the same members one is kept (near copies share hundreds).
2. Signature trees (sigtree) are built over the groups' sets, and a dual walk gives the candidate pairs; these are
   verified by their full sets. Groups of up to `few` members are walked whole. In larger ones each set is first walked
   against one representative of those with the same least shingle, then against `hubs` of the group's largest class
   (sets known to be connected), and then the whole group is walked, where nodes of one class aren't compared.
3. Links give components.

A group of over `block` members is dealt by hash to blocks by Spark, and its block pairs are cells of their own.
Shingles that are seen far more often than others are not even gathered by key: their groups
are dealt unseen. Nothing is dropped.

Null texts and texts without words have an empty set, no links, and their own
doc_id as component. A text of fewer than 5 words is one shingle. Rows that repeat a
doc_id are rows of their own, told apart by their locators; null ids come after all others. Other columns
of the input aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import components as cc
from . import dedup, sigtree, staging, text

#: Buckets of the table of often-seen shingles: its size doesn't depend on the input.
OFTEN = 1 << 22
#: Added to a bucket's level if it is seen far more often than the mean one.
HOT = 128


def set_id(tokens: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).view(np.int64))


def _texts(docs: DataFrame, id_col: str, text_col: str, locator: Column | None) -> DataFrame:
    """doc_id, text, at (where the row is: a hash), locator."""
    place = F.col(id_col).cast("string") if locator is None else locator
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(place).alias("at"), place.alias("locator"))


def profile(docs: DataFrame, *, chunk: int = 1_000_000, often: int = 3) -> DataFrame:
    """Two kinds of rows: of each document (kind 0, doc_id, set_id, n, least, bitmap, wide (a bitmap of more bits), locator), and counts of often-seen shingles by bucket (kind 1, set_id: bucket, n: count).

    least: the least shingle. A task counts shingles in chunks of about `chunk`; those in `often` of a chunk's sets at least are reported.
    """
    kinds = {"kind": pa.int32(), "doc_id": pa.int64(), "set_id": pa.int64(), "n": pa.int64(), "least": pa.int64(), "bitmap": pa.binary(), "wide": pa.binary(), "locator": pa.string()}

    def run(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(list(held.values())), return_counts=True)
            many = counts >= often
            held.clear()
            none = lambda kind, n=int(many.sum()): pa.nulls(n, kind)
            columns = [pa.array(np.ones(int(many.sum()), np.int32)), none(pa.int64()), pa.array((values[many] % np.uint64(OFTEN)).astype(np.int64)), pa.array(counts[many].astype(np.int64)), none(pa.int64()), none(pa.binary()), none(pa.binary()), none(pa.string())]
            return pa.record_batch(columns, list(kinds))

        for batch in them:
            ids, sizes, least, maps, wide = [], [], [], [], []
            for tokens in text.shingle_sets(batch.column("text")):
                own = set_id(tokens) if len(tokens) else None
                ids.append(own)
                sizes.append(len(tokens))
                least.append(int(tokens[:1].view(np.int64)[0]) if len(tokens) else None)
                maps.append(sigtree.bitmap(tokens).tobytes() if len(tokens) else None)
                wide.append(sigtree.bitmap(tokens, 4).tobytes() if len(tokens) else None)
                if own is not None and own not in held:
                    held[own] = tokens
                    size += len(tokens)
                if size >= chunk:
                    size = 0
                    yield flush()
            columns = [pa.array(np.zeros(len(ids), np.int32)), batch.column("doc_id"), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(least, pa.int64()), pa.array(maps, pa.binary()), pa.array(wide, pa.binary()), batch.column("locator")]
            yield pa.record_batch(columns, list(kinds))
        if held:
            yield flush()

    return docs.select("doc_id", "text", "locator").mapInArrow(run, "kind int, doc_id long, set_id long, n long, least long, bitmap binary, wide binary, locator string")


def often_seen(counts: DataFrame, hot: int) -> np.ndarray:
    """OFTEN levels: the logarithm of a bucket's reported count, 0 without one; over `hot` and 16 times the mean, with HOT added."""
    counts = counts.groupBy("set_id").agg(F.sum("n").alias("n"))

    def packed(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, n = (batch.column(c).to_numpy() for c in ("set_id", "n"))
        return pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in (at.astype("<u4"), n.astype("<u8"))], ["at", "n"])

    totals = np.zeros(OFTEN, np.float64)
    for row in counts.mapInArrow(text.batches(packed), "at binary, n binary").toLocalIterator():  # 12 bytes for each of OFTEN buckets at most
        totals[np.frombuffer(row["at"], "<u4")] = np.frombuffer(row["n"], "<u8")
    levels = np.where(totals > 0, 1 + np.log2(np.maximum(totals, 1)), 0).astype(np.uint8)
    return levels + (totals > hot + 16 * totals.mean()).astype(np.uint8) * np.uint8(HOT)


def leading(n: int) -> int:
    """How many of a prefix's first tokens have at least 6/7 of the set's n tokens from them on."""
    return n - (6 * n + 6) // 7 + 1


def prefix(tokens: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first n - ceil(0.75 n) + 1 tokens in the order of (level, hash), and which are hot."""
    n = len(tokens)
    length = n - (3 * n + 3) // 4 + 1
    level = levels[(tokens & np.uint64(OFTEN - 1)).astype(np.int64)]
    at = np.argsort(level, kind="stable")[:length] if level.any() else slice(0, length)
    return tokens[at], level[at] >= HOT


PREFIX = "key long, salt int, set_id long, lead boolean"


def prefixes(docs: DataFrame, levels: np.ndarray, salts: int = 1024) -> DataFrame:
    """PREFIX rows for each shingle of each set's prefix; a batch has each set once. salt: -1, or of a hot shingle one of `salts` by the set."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # 4 MB, whatever the input

    def run(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            keys, hots, ids, sizes = [], [], [], []
            done: set[int] = set()
            for tokens in text.shingle_sets(batch.column("text")):
                if not len(tokens) or (own := set_id(tokens)) in done:
                    continue
                done.add(own)
                key, hot = prefix(tokens, shared.value)
                keys.append(key)
                hots.append(hot)
                ids.append(own)
                sizes.append(len(tokens))
                if sum(map(len, keys)) > 200_000:
                    yield out(keys, hots, ids, sizes)
                    keys, hots, ids, sizes = [], [], [], []
            if keys:
                yield out(keys, hots, ids, sizes)

    def out(keys: list, hots: list, ids: list, sizes: list) -> pa.RecordBatch:
        lengths = [len(k) for k in keys]
        own, hot = np.repeat(np.array(ids, np.int64), lengths), np.concatenate(hots)
        salt = np.where(hot, own % salts, -1).astype(np.int32)
        lead = np.concatenate([np.arange(m) < leading(n) for m, n in zip(lengths, sizes, strict=True)])
        columns = [np.concatenate(keys).view(np.int64), salt, own, lead]
        return pa.record_batch([pa.array(x) for x in columns], [c.split()[0] for c in PREFIX.split(", ")])

    return docs.select("text").mapInArrow(run, PREFIX)


MEMBERS = "list long, set_id long, m long"


def groups(rows: DataFrame) -> DataFrame:
    """MEMBERS of the groups of PREFIX rows, in order of (salt, key, set_id) and with each key in one partition, that have two members and a leading one.

    list: of the members, the same for groups with the same ones; m: how many. Of a hot shingle: one for the shingle, with m = -1, as its rows come from several tasks.
    """

    def run(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []
        for batch in them:
            if not batch.num_rows:
                continue
            got = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)]
            rest = [np.concatenate(x) for x in zip(rest, got, strict=True)] if rest else got
            # the last group may go on in the next batch
            last = (rest[0] == rest[0][-1]) & (rest[1] == rest[1][-1])
            cut = len(last) - int(last[::-1].argmin()) if not last.all() else 0
            if cut:
                yield from whole([x[:cut] for x in rest])
                rest = [x[cut:] for x in rest]
        if rest:
            yield from whole(rest)

    def whole(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, salt, ids, lead = rows
        other = np.append(True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]))
        starts = np.flatnonzero(other)
        leads = np.logical_or.reduceat(lead, starts)
        first = other | np.append(True, ids[1:] != ids[:-1])  # each set once
        m = np.add.reduceat(first.astype(np.int64), starts)
        lists = np.add.reduceat(text._mixed(ids.view(np.uint64)) * first, starts)
        hot = salt[starts] >= 0
        lists, m = np.where(hot, text._mixed(key[starts].view(np.uint64)), lists), np.where(hot, -1, m)
        kept = hot | ((m > 1) & leads)
        # a list only once here
        again = np.zeros(len(starts), bool)
        at = np.flatnonzero(kept & ~hot)
        again[at] = True
        again[at[np.unique(lists[at], return_index=True)[1]]] = False
        size = np.diff(np.append(starts, len(key)))
        chosen = np.repeat(kept & ~again, size) & first
        if chosen.any():
            columns = [np.repeat(lists.view(np.int64), size), ids, np.repeat(m, size)]
            yield pa.record_batch([pa.array(x[chosen]) for x in columns], [c.split()[0] for c in MEMBERS.split(", ")])

    return rows.mapInArrow(run, MEMBERS)


CELLS = ["cell", "side", "set_id", "n", "comp"]


def stars(rows: DataFrame, of: str, reps: DataFrame, block: int) -> DataFrame:
    """CELLS that pair the rows(of, set_id, n, comp) of each group with the group's representatives, of the staged reps(of, r, m): r an array of (set_id, n, comp) of one class; m members, with one cell for each `block` of them."""
    parts = F.ceil(F.col("m") / block).cast("long")
    cell = lambda part: F.xxhash64(of, part).alias("cell")
    met = rows.join(staging.small(reps.select(of, "m", F.col("r")[0]["comp"].alias("rep_comp"))), of).where("comp <> rep_comp")
    members = met.select(cell(F.pmod(F.xxhash64("set_id"), parts)), F.lit(1).alias("side"), "set_id", "n", "comp")
    each = reps.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return members.unionByName(each.select(cell(F.col("part")), F.lit(0).alias("side"), F.inline("r")))


def picked(n: int = 1) -> list[Column]:
    """Aggregates: n rows (set_id, n, comp), each of the least hash with another seed, so that overlapping groups pick the same, and the number of rows."""
    one = lambda i: F.min(F.struct(F.xxhash64(F.lit(i), "set_id").alias("h"), F.struct("set_id", "n", "comp").alias("v")))["v"]
    return [F.array_distinct(F.array(*[one(i) for i in range(n)])).alias("r"), F.count(F.lit(1)).alias("m")]


#: What members of one class have in common, and bands of sizes: linked sets are in one, or in neighbouring ones.
CLASS = ["band", "major"]
BAND_OF_SIZES = 1.34


def dealt(rows: DataFrame, block: int) -> tuple[DataFrame, list[DataFrame]]:
    """CELLS of the block pairs of the groups of rows(list, set_id, n, comp, major), staged, that are too large for one task; and the staged tables that they are read from.

    A group's members are dealt by hash to blocks within a class (band of sizes, in the group's largest component),
    and each goes to all blocks of the classes that its own can link with.
    """
    rows = staging.stage(rows.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(BAND_OF_SIZES))), "jaccard-classes")
    sizes = staging.stage(rows.groupBy("list", *CLASS).agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks")), "jaccard-class-sizes")
    theirs = sizes.select("list", *(F.col(c).alias(f"{c}_") for c in CLASS), F.col("blocks").alias("blocks_"))
    partners = sizes.join(theirs, "list").where((F.abs(F.col("band") - F.col("band_")) <= 1) & ~(F.col("major") & F.col("major_")))
    own, other = F.struct(*CLASS), F.struct(*(F.col(f"{c}_").alias(c) for c in CLASS))
    partners = staging.stage(partners, "jaccard-partners")
    met = rows.join(staging.small(partners), ["list", *CLASS])
    met = met.withColumn("i", F.pmod(F.xxhash64("set_id"), "blocks")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks_") - 1)))
    first = (own < other) | ((own == other) & (F.col("i") <= F.col("j")))
    one = (own == other) & (F.col("i") == F.col("j"))
    here, there = F.struct(own.alias("c"), "i"), F.struct(other.alias("c"), F.col("j").alias("i"))
    number = F.xxhash64("list", F.when(first, here).otherwise(there), F.when(first, there).otherwise(here))
    return met.select(number.alias("cell"), F.when(one, -1).when(first, 0).otherwise(1).alias("side"), "set_id", "n", "comp"), [rows, sizes, partners]


def together(met: DataFrame, most: DataFrame, block: int) -> tuple[DataFrame, list[DataFrame]]:
    """The rows(list, set_id, n, comp, most, m), with each set once, of the groups that have the same largest class, and the staged tables that they are read from.

    Such groups share most of their sets, so apart they give a pair and its bitmaps many times. most: (list, most, m) of each group. Those that would have more rows together, in cells of `block`, stay apart.
    """
    rows = lambda m: m * F.ceil(m / block)
    union = staging.stage(met.select("most", "set_id", "n", "comp").distinct(), "jaccard-union")
    sizes = union.groupBy("most").agg(F.count(F.lit(1)).alias("of_union")).join(most.groupBy("most").agg(F.sum(rows(F.col("m"))).alias("apart")), "most")
    sizes = staging.stage(sizes.select("most", "of_union", (rows(F.col("of_union")) <= F.col("apart")).alias("one")), "jaccard-unions")
    ones = union.join(staging.small(sizes.where("one").select("most", F.col("of_union").alias("m"))), "most").withColumn("list", F.xxhash64("most"))
    apart = met.join(staging.small(sizes.where("NOT one").select("most")), "most", "left_semi")
    return ones.unionByName(apart), [union, sizes]


def whole_cells(them: Iterator[pa.RecordBatch], rows: int = 20_000, size: int = 1 << 24) -> Iterator[pa.Table]:
    """The rows of batches in order of cells, some whole cells at a time."""
    held: list[pa.RecordBatch] = []
    for batch in (part for b in them for part in (b.slice(k, 2000) for k in range(0, b.num_rows, 2000))):
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= size:
            table = pa.Table.from_batches(held)
            cell = table.column("cell").to_numpy()
            cut = int(np.searchsorted(cell, cell[-1]))
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def walk(cells: DataFrame, of_docs: DataFrame, width: str) -> DataFrame:
    """(a, b) that may link, of CELLS and the bitmaps, in column `width` of the staged of_docs, of their sets, staged. Only the bitmaps of the cells' sets are shuffled, once each."""
    cells = staging.stage(cells, "jaccard-cells")
    ids = staging.stage(cells.select("set_id").distinct(), "jaccard-ids")
    maps = of_docs.select("set_id", F.col(width).alias("bitmap")).join(staging.small(ids), "set_id", "left_semi").groupBy("set_id").agg(F.first("bitmap").alias("bitmap"))

    def run(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_cells(them):
            cell, side, ids, n, comp = (table.column(c).to_numpy() for c in CELLS)
            entries = sigtree.Entries(cell, side, n.astype(np.int64), comp)
            found = sigtree.forest(table.column("bitmap").to_pylist(), entries)
            i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            both = np.unique(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])]), axis=1)
            if both.shape[1]:
                yield pa.record_batch([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    rows = cells.join(maps, "set_id").select(*CELLS, "bitmap").repartition("cell").sortWithinPartitions("cell")
    found = staging.stage(rows.mapInArrow(run, "a long, b long").distinct(), "jaccard-left")
    staging.drop(cells, ids)
    return found


def tokens_of(ids: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """(set_id, tokens) of the staged ids(set_id), which are dropped, staged. sets: (set_id, at) of every set, at being a row's with that set.

    Rows are found by the hash of their locators; what else has that hash is read for nothing.
    """
    rows = staging.stage(sets.join(staging.small(ids), "set_id", "left_semi").select("at").distinct(), "jaccard-rows")

    def whole(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            for lo in range(0, batch.num_rows, 256):
                found = {set_id(t): t.tobytes() for t in text.shingle_sets(batch.column("text").slice(lo, 256)) if len(t)}
                yield pa.record_batch([pa.array(list(found), pa.int64()), pa.array(found.values(), pa.binary())], ["set_id", "tokens"])

    full = docs.select("text", "at").join(staging.small(rows), "at", "left_semi").select("text").mapInArrow(whole, "set_id long, tokens binary")
    full = staging.stage(full, "jaccard-tokens")
    staging.drop(ids, rows)
    return full


def linked(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The (a, b) of the staged pairs(a, b) whose full sets (set_id, tokens) link, staged. Few pairs are broadcast, so that only their sets' tokens are shuffled."""

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok = []
        for x, y in zip(batch.column("ta"), batch.column("tb"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.sort(np.concatenate([x, y]), kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            ok.append(100 * shared >= 75 * (len(x) + len(y) - shared))
        keep = pa.array(ok, pa.bool_())
        return pa.record_batch([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    side = lambda own, name: full.select(F.col("set_id").alias(own), F.col("tokens").alias(name))
    few = staging.fits(pairs)
    own, theirs = (F.broadcast(pairs), F.broadcast(pairs.select("b"))) if few else (pairs, pairs.select("b"))
    met = side("a", "ta").join(own, "a").join(side("b", "tb").join(theirs, "b", "left_semi"), "b").select("a", "b", "ta", "tb")
    return staging.stage(met.mapInArrow(text.batches(compare), "a long, b long"), "jaccard-links")


def classes(links: DataFrame, rounds: int = 2) -> DataFrame:
    """(set_id, comp) of the ends of links(a, b), staged: sets of one comp are connected; after so few rounds connected sets may be of several."""
    both = links.select(F.col("a").alias("set_id"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("set_id"), F.col("a").alias("other")))
    comp = staging.stage(both.groupBy("set_id").agg(F.least(F.min("other"), F.col("set_id")).alias("comp")), "jaccard-comp")
    for _ in range(rounds):
        # the least class of a set's neighbours, and that class's own
        theirs = staging.small(comp.select(F.col("set_id").alias("other"), F.col("comp").alias("near")))
        further = staging.small(comp.select(F.col("set_id").alias("near"), F.col("comp").alias("further")))
        least = both.join(theirs, "other").groupBy("set_id").agg(F.min("near").alias("near")).join(further, "near", "left")
        least = staging.stage(least.select("set_id", F.least("near", "further").alias("comp")), "jaccard-comp")
        staging.drop(comp)
        comp = least
    return comp


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", often: int = 3, few: int = 16, block: int = 512, hubs: int = 16, hot: int = 8192, locator: Column | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs. component_id: the smallest doc_id reachable by links.

    locator: says where a row is, as a string; by default its id. If given, kept and locator are columns of the result. kept: of the rows reachable by links, the one with the smallest
    doc_id, then locator; and every row without words.
    """
    docs = _texts(docs, id_col, text_col, locator)
    rows = staging.stage(profile(docs, often=often), "jaccard-profile")
    of_docs = rows.where("kind = 0").drop("kind")
    sets = staging.stage(of_docs.where("n > 0").groupBy("set_id").agg(dedup.least_row().alias("first"), F.first("n").cast("int").alias("n"), F.first("least").alias("least")).withColumn("at", F.xxhash64("first.locator")), "jaccard-nodes")
    if sets.isEmpty():
        return of_docs.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), *([] if locator is None else [F.lit(True).alias("kept"), "locator"]))

    # 1. groups of prefix shingles, one for each list of members
    keyed = prefixes(docs, often_seen(rows.where("kind = 1"), hot)).repartition("key", "salt").sortWithinPartitions("salt", "key", "set_id")
    found = staging.stage(groups(keyed), "jaccard-groups")
    members = staging.stage(found.dropDuplicates(["list", "set_id"]).join(sets.select("set_id", "n", "least"), "set_id").withColumn("comp", F.col("set_id")), "jaccard-members")
    staging.drop(found)

    # 2. small groups whole, large ones against those that share their least shingle
    small, large = members.where(F.col("m").between(2, few)), members.where((F.col("m") < 0) | (F.col("m") > few))
    cells = small.select(F.col("list").alias("cell"), F.lit(-1).alias("side"), "set_id", "n", "comp")
    alike = large.select(F.xxhash64("list", "least").alias("own"), "set_id", "n", "comp")
    reps = staging.stage(alike.groupBy("own").agg(*picked()).where("m > 1"), "jaccard-reps")
    left = walk(cells.unionByName(stars(alike, "own", reps, block)), of_docs, "bitmap")
    ids = left.select(F.col("a").alias("set_id")).union(left.select("b")).union(large.select("set_id")).distinct()
    full = tokens_of(staging.stage(ids, "jaccard-ids"), sets, docs)
    found = [linked(left, full)]
    staging.drop(left, reps)
    for last in (False, True):
        comp = classes(reduce(DataFrame.unionByName, found))
        several = large.drop("comp").join(staging.small(comp), "set_id", "left").withColumn("comp", F.coalesce("comp", "set_id"))
        several = staging.stage(several.select("list", "set_id", "n", "comp"), "jaccard-several")
        by_comp = staging.stage(several.groupBy("list", "comp").agg(F.count(F.lit(1)).alias("m")), "jaccard-by-comp")
        most = by_comp.groupBy("list").agg(F.max(F.struct("m", "comp")).alias("most"), F.sum("m").alias("of_all")).where("of_all > most.m")
        most = staging.stage(most.select("list", F.col("most.comp").alias("most"), F.col("of_all").alias("m")), "jaccard-most")
        met = several.join(staging.small(most), "list")
        if last:  # whole groups
            met, unions = together(met, most, block)
            met = met.withColumn("major", F.col("comp") == F.col("most"))
            cells = met.where(F.col("m") <= block).select(F.col("list").alias("cell"), F.lit(-1).alias("side"), "set_id", "n", "comp")
            deal, read = dealt(met.where(F.col("m") > block).select("list", "set_id", "n", "comp", "major"), block)
            cells, read = cells.unionByName(deal), [*unions, *read]
        else:  # against some of the largest class, the same for all groups with that class, so that a set meets them once
            met = staging.stage(met.where("comp <> most").select("most", "set_id", "n", "comp").distinct(), "jaccard-met")
            some = several.join(staging.small(most.select(F.col("most").alias("comp")).distinct()), "comp", "left_semi").groupBy(F.col("comp").alias("most")).agg(picked(hubs)[0])
            reps = staging.stage(some.join(met.groupBy("most").agg(F.count(F.lit(1)).alias("m")), "most"), "jaccard-reps")
            cells, read = stars(met, "most", reps, block), [met, reps]
        left = walk(cells, of_docs, "wide")
        found.append(linked(left, full))
        staging.drop(comp, several, by_comp, most, left, *read)

    # 3. components of sets, and the smallest doc_id of each
    part = staging.stage(cc.components(reduce(DataFrame.unionByName, found)), "jaccard-parts")
    staging.drop(members, full, *found)
    least = part.join(sets.select(F.col("set_id").alias("node"), "first"), "node").groupBy("component").agg(F.min("first").alias("least"))
    least = staging.stage(least, "jaccard-least")
    of_set = part.join(least, "component").select(F.col("node").alias("set_id"), "least")
    of_set = sets.select("set_id", "first").join(of_set, "set_id", "left").select("set_id", F.coalesce("least", "first").alias("least"))
    of_set = staging.stage(of_set, "jaccard-of-set")
    staging.drop(part, least)
    kept = F.col("n").eqNullSafe(0) | (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & F.col("locator").eqNullSafe(F.col("least.locator")))
    own_id = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("least.doc_id"))
    return of_docs.select("doc_id", "set_id", "n", "locator").join(of_set, "set_id", "left").select("doc_id", F.col("n").alias("n_shingles"), own_id.alias("component_id"), *([] if locator is None else [kept.alias("kept"), "locator"]))
