"""As-of joins with versioned tables, interval and time-band joins, correlation with a fallback key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, TimestampNTZType, TimestampType, VariantType
from pyspark.sql.window import Window

from ..functions.scalars import epoch_us

#: A side is joined by broadcast only if its rows have no more bytes than this, as JSON text and 16 for each value.
BROADCAST_BYTES = 32 << 20


#: Rows of one key that are sorted in one run; a key of more is cut into slices of time, HOT_SLICES at most.
HOT_ROWS, HOT_SLICES = 1_000_000, 1_000
#: Inputs that are no larger by the optimizer's estimate aren't searched for hot keys.
SMALL_BYTES = 64 << 20


def _estimate(df: DataFrame) -> int:
    """The bytes of a frame by the optimizer's estimate, which is large where nothing is known."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def hot_slices(rows: DataFrame, keys: Sequence[str], ts: str, hot_rows: int) -> DataFrame | None:
    """The keys with over hot_rows rows and `cuts`, the quantiles (epoch microseconds) that cut their rows into slices of about hot_rows; None if no key is hot.

    Two partial aggregations over keys and times alone; the second is of hot keys' rows. There are at most (all rows / hot_rows) hot keys and as many cuts.
    """
    hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).persist()
    most = hot.agg(F.max("_n")).first()[0]
    if most is None:
        hot.unpersist()
        return None
    n = min(HOT_SLICES, -(-most // hot_rows))
    small = F.broadcast if _fits(hot, BROADCAST_BYTES) else (lambda df: df)
    every = F.percentile_approx(F.col("_us"), [i / n for i in range(1, n)], max(10_000, 10 * n)).alias("_every")
    found = rows.select(*keys, epoch_us(F.col(ts)).alias("_us")).join(small(hot), list(keys)).groupBy(*keys, "_n").agg(every)
    own = F.least(F.lit(n), F.ceil(F.col("_n") / hot_rows)).cast("int")
    cuts = F.transform(F.sequence(F.lit(1), own - 1), lambda i: F.element_at("_every", F.ceil(i * n / own).cast("int")))
    out = found.select(*keys, F.array_distinct(cuts).alias("cuts")).persist()
    return F.broadcast(out) if _fits(out, BROADCAST_BYTES) else out


def _fits(df: DataFrame, most: int) -> bool:
    text = F.coalesce(F.octet_length(F.to_json(F.struct("*"))), F.lit(0)) if df.columns else F.lit(0)
    return (df.agg(F.sum(text + 16 * len(df.columns))).first()[0] or 0) <= most


def _free(name: str, *frames: DataFrame) -> str:
    """name, or the first of it with underscores before it that is no column of the frames."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _no_nulls(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in cols))


def _interval(within: str) -> Column:
    return F.expr(f"INTERVAL {within}")


def _ordered_type(kind: DataType) -> bool:
    """Whether values of a type can be sorted."""
    if isinstance(kind, StructType):
        return all(_ordered_type(f.dataType) for f in kind.fields)
    return _ordered_type(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, MapType | VariantType)


def bucket_of(ts: Column, size: str) -> Column:
    """The number of the time bucket of a timestamp."""
    return F.floor(epoch_us(ts) / _micros(size))


def _near(ts: Column, size: str) -> Column:
    """The numbers of a timestamp's bucket and of those beside it."""
    return F.array(*[bucket_of(ts, size) + i for i in (-1, 0, 1)])


def _micros(within: str) -> int:
    """A duration such as "30 seconds" in microseconds."""
    unit = {"microsecond": 1, "millisecond": 1000, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6}
    words = within.split()
    return sum(int(n) * unit[u.rstrip("s")] for n, u in zip(words[::2], words[1::2], strict=True))


def _dealt(df: DataFrame, *cols: str | Column) -> DataFrame:
    """df dealt by cols to as many tasks as shuffles have. Adaptive execution would merge them by their bytes, which tell little of the pairs that a join makes of them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def large(*frames: DataFrame) -> bool:
    """Whether each of the frames (no streams) is over SMALL_BYTES by the optimizer's estimate, so that their join isn't left to the optimizer."""
    return not any(df.isStreaming for df in frames) and all(_estimate(df) > SMALL_BYTES for df in frames)


def with_bucket(df: DataFrame, name: str, on: Sequence[str], ts: str, within: str, *, deal: bool) -> DataFrame:
    """df with the column `name` for interval_join's `bucket`; deal: dealt by it and the keys."""
    df = df.withColumn(name, bucket_of(F.col(ts), within))
    return _dealt(df, *on, name) if deal else df


def version_order(df: DataFrame, tiebreak: str | None) -> list[str]:
    """The columns that order versions of equal time, in every form of the as-of join: `tiebreak` by its own type, then all columns that can be ordered (maps can't). NULL comes first, NaN last."""
    return [*([tiebreak] if tiebreak in df.columns else []), *[f.name for f in df.schema if _ordered_type(f.dataType)]]


def asof_enrich(fact: DataFrame, tables: Mapping[str, tuple[DataFrame, str]], *, on: Sequence[str], ts: str, tiebreak: str | None = None, time_slice: str | None = None, hot_rows: int | None = None) -> DataFrame:
    """fact with, for each table, a struct column of its version that was current at `ts` (the greatest version <= ts; NULL if none).

    All tables are joined by one shuffle and one sort: facts and versions are put in one order by key
    and time, versions first at equal times, and each fact takes the last version before it.
    Facts with a NULL key or time match nothing. Equal versions of a key are ordered by version_order.
    time_slice (such as "1 day"): sorts each key's rows by slices of time, and hands the last versions on
    from slice to slice, so that one hot key is many tasks.
    hot_rows: without time_slice, keys of more rows are found by a count of keys and cut at quantiles of their times; other keys' rows stay whole. By default HOT_ROWS,
    without a search if the inputs are small; 0: no search. The rows are the same in each case.
    """
    sides, keys = [f"v{i}" for i in range(len(tables))], [f"k{i}" for i in range(len(on))]
    kinds = [df.schema for df, _ in tables.values()]
    none = [F.lit(None).cast(kind) for kind in kinds]

    def rows(df: DataFrame, time: str, own: int | None) -> DataFrame:
        whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
        cols = [(whole if i == own else none[i]).alias(side) for i, side in enumerate(sides)]
        mine = whole if own is None else F.lit(None).cast(fact.schema)
        at = F.col(f"`{time}`")
        return df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(on, keys, strict=True)], at.alias("t"), F.lit(int(own is None)).alias("side"), mine.alias("fact"), *cols)

    every = rows(_no_nulls(fact, [*on, ts]), ts, None)
    for i, (df, version) in enumerate(tables.values()):
        every = every.unionByName(rows(_no_nulls(df, [*on, version]), version, i))
    # a table whose columns all sort is sorted by its struct, as it is in the row already; the tiebreak goes before it
    orders = []
    for side, kind, (df, _) in zip(sides, kinds, tables.values(), strict=True):
        first = [F.col(f"{side}.`{tiebreak}`")] if tiebreak in df.columns else []
        rest = F.col(side) if _ordered_type(kind) else F.struct(F.col(side).isNotNull(), *[F.col(f"{side}.`{c}`").alias(c) for c in version_order(df, None)])
        orders.append([*first, rest])
    every, sliced = _in_slices(every, keys, time_slice, hot_rows)
    if sliced:
        last = [F.max_by(F.col(side), F.when(F.col(side).isNotNull(), F.struct("t", *order))).alias(side) for side, order in zip(sides, orders, strict=True)]
        past = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        ends = every.where("slice IS NOT NULL").groupBy(*keys, "slice").agg(*last).select(*keys, "slice", *[F.last(side, ignorenulls=True).over(past).alias(side) for side in sides])
        handed = ends.select(*keys, F.lit(None).cast(every.schema["t"].dataType).alias("t"), F.lit(-1).alias("side"), F.lit(None).cast(fact.schema).alias("fact"), *sides, "slice")
        every = every.unionByName(handed)
    w = Window.partitionBy(*keys, *(["slice"] if sliced else [])).orderBy(F.asc_nulls_first("t"), "side", *[c for order in orders for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = every.select("fact", *[F.last(side, ignorenulls=True).over(w).alias(side) for side in sides]).where("fact IS NOT NULL")
    out = out.select("fact.*", *[F.col(side).alias(n) for side, n in zip(sides, tables, strict=True)])
    lost = fact.where(" OR ".join(f"`{c}` IS NULL" for c in [*on, ts])).select("*", *[v.alias(n) for v, n in zip(none, tables, strict=True)])
    return out.unionByName(lost)


def _in_slices(rows: DataFrame, keys: Sequence[str], time_slice: str | None, hot_rows: int | None) -> tuple[DataFrame, bool]:
    """rows with `slice`, the number of the slice of time (NULL: of a key that stays whole), and whether there are any slices."""
    if time_slice:
        return rows.withColumn("slice", F.floor(epoch_us(F.col("t")) / _micros(time_slice))), True
    timed = isinstance(rows.schema["t"].dataType, TimestampType | TimestampNTZType)
    if hot_rows == 0 or not timed or not keys or (hot_rows is None and _estimate(rows) <= SMALL_BYTES):
        return rows, False
    hot = hot_slices(rows.select(*keys, "t"), keys, "t", hot_rows or HOT_ROWS)
    if hot is None:
        return rows, False
    at = F.when(F.col("cuts").isNotNull(), F.size(F.filter("cuts", lambda cut: cut < epoch_us(F.col("t")))).cast("long"))
    return rows.join(hot, list(keys), "left").withColumn("slice", at).drop("cuts"), True


def asof_join(left: DataFrame, right: DataFrame, *, on: Sequence[str], left_ts: str, right_ts: str, how: str = "left", tiebreak: str | None = None, prefix: str = "", broadcast: bool = False, time_slice: str | None = None, hot_rows: int | None = None) -> DataFrame:
    """left with the columns of right's version that was current at left_ts (right's keys left out, its other names prefixed).

    how: left, or inner to drop rows without a version. broadcast: right is thought to be small; if its rows have at most BROADCAST_BYTES (they are summed up), it is joined as
    version ranges without shuffling left. Both ways give the same rows.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"how is left or inner, not {how}")
    others = [c for c in right.columns if c not in on]
    if broadcast and _fits(right, BROADCAST_BYTES):
        order = Window.partitionBy(*on).orderBy(right_ts, *[F.col(f"`{c}`") for c in version_order(right, tiebreak)])
        keys, from_, to = [_free(f"_k_{k}", left) for k in on], _free("_from", left), _free("_to", left)
        ranges = _no_nulls(right, [*on, right_ts])
        ranges = ranges.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(on, keys, strict=True)], F.col(right_ts).alias(from_), F.lead(right_ts).over(order).alias(to), *[F.col(f"`{c}`").alias(f"{prefix}{c}") for c in others])
        match = (F.col(left_ts) >= F.col(from_)) & (F.col(to).isNull() | (F.col(left_ts) < F.col(to)))
        for c, k in zip(on, keys, strict=True):
            match &= F.col(c) == F.col(k)
        return left.join(F.broadcast(ranges), match, how).drop(from_, to, *keys)
    name = _free("_version", left)
    out = asof_enrich(left, {name: (right, right_ts)}, on=on, ts=left_ts, tiebreak=tiebreak, time_slice=time_slice, hot_rows=hot_rows)
    if how == "inner":
        out = out.where(F.col(name).isNotNull())
    return out.select(*[F.col(f"`{c}`") for c in left.columns], *[F.col(f"{name}.`{c}`").alias(f"{prefix}{c}") for c in others])


#: Kinds of interval joins by their names.
_HOW = {"inner": "inner", "left": "left", "leftouter": "left", "right": "right", "rightouter": "right", "full": "full", "outer": "full", "fullouter": "full", "semi": "leftsemi", "leftsemi": "leftsemi", "anti": "leftanti", "leftanti": "leftanti"}


def interval_join(left: DataFrame, right: DataFrame, *, on: Sequence[str], left_ts: str, right_ts: str, within: str, how: str = "inner", extra: Column | None = None, bucketed: bool | None = None, prefix: str = "", bucket: str | None = None) -> DataFrame:
    """Pairs of equal key whose times differ by `within` at most (both ends count). Works on streams with watermarks too.

    how: inner, left, right, full, semi or anti, as in Spark's joins. extra: a further condition over left's names and right's prefixed names. bucketed: time buckets join the
    key, so that a busy key is many small groups, and one side's rows go to three buckets (right's; left's in a right join, whose rows must come out once); by default in batches, but not on streams.
    bucket (inner and left joins): a column of left that is bucket_of(left_ts, within) already. It stays, and left with it where it lies, so that joins one after the other by one key and time shuffle no pairs.
    """
    kind = _HOW.get(how.lower().replace("_", ""))
    if kind is None:
        raise ValueError(f"how is inner, left, right, full, semi or anti, not {how}")
    if bucketed is None:
        bucketed = not (left.isStreaming or right.isStreaming)
    named = {c: _free(f"_k_{c}", left, right) if c in on else f"{prefix}{c}" for c in right.columns}
    right = right.select(*[F.col(f"`{c}`").alias(n) for c, n in named.items()])
    right_ts, keys = named[right_ts], [named[k] for k in on]
    columns, first, last = left.columns, F.col(left_ts) - _interval(within), F.col(left_ts) + _interval(within)
    if not (left.isStreaming or right.isStreaming):
        # once a row: sums of times and intervals cost more than the rest of a pair. Streams find by the sums what they may forget
        ends = _free("_first", left, right), _free("_last", left, right)
        left, first, last = left.select("*", first.alias(ends[0]), last.alias(ends[1])), F.col(ends[0]), F.col(ends[1])
    match = (F.col(right_ts) >= first) & (F.col(right_ts) <= last)
    for c, k in zip(on, keys, strict=True):
        match &= F.col(c) == F.col(k)
    if extra is not None:
        match &= extra
    others = [F.col(f"`{c}`") for c in right.columns if c not in keys]

    def shown(joined: DataFrame, sides: str = kind) -> DataFrame:
        """Without helpers; rows that only right has carry its keys."""
        of_left = [F.coalesce(F.col(f"`{c}`"), F.col(named[c])).alias(c) if sides == "right" and c in on else F.col(f"`{c}`") for c in columns]
        return joined.select(*of_left, *([] if sides in ("leftsemi", "leftanti") else others))

    one, three = bucket or _free("_bucket", left, right), _free("_near", left, right)
    deal = bucketed and large(left, right)

    def single(df: DataFrame, t: str) -> DataFrame:
        if bucket or not bucketed:
            return df
        df = df.withColumn(one, bucket_of(F.col(t), within))
        return _dealt(df, *(on if t == left_ts else keys), one) if deal else df

    def spread(df: DataFrame, t: str) -> DataFrame:
        if not bucketed:
            return df
        df = df.withColumn(three, F.explode(_near(F.col(t), within)))
        return _dealt(df, *(on if t == left_ts else keys), three) if deal else df

    if bucketed:
        match &= F.col(one) == F.col(three)
    if kind == "right":
        return shown(spread(left, left_ts).join(single(right, right_ts), match, kind))
    if kind == "full" and not bucketed:
        return shown(left.join(right, match, kind), "right")
    if kind == "full":
        alone = single(right, right_ts).join(spread(left, left_ts), match, "leftanti")
        alone = alone.select(*[(F.col(named[f.name]) if f.name in on else F.lit(None)).cast(f.dataType).alias(f.name) for f in left.select(*[F.col(f"`{c}`") for c in columns]).schema], *others)
        return shown(single(left, left_ts).join(spread(right, right_ts), match, "left")).unionByName(alone)
    return shown(single(left, left_ts).join(spread(right, right_ts), match, kind))


def near_sums(left: DataFrame, right: DataFrame, *, on: Sequence[str], left_ts: str, right_ts: str, within: str, sums: Mapping[str, Column]) -> DataFrame:
    """left's rows that have a key and a time, with sums of whole numbers or decimals over the rows of right that interval_join would pair them with (0 if none); no pair is made.

    Rows and marks of time are put in order by key and bucket: of the bucket before a left row's own what comes from its time less `within` on, all of its own, and of the next what comes up to its time plus `within`. So the work
    grows with the rows, however many are near each other. Columns of left must be groupable (no maps).
    On streams (with watermarks) the rows of right near a bucket are put into one list, which must fit in a row, so that a left row meets one entry of state; it goes through that list.
    """
    if left.isStreaming or right.isStreaming:
        return _near_sums_stream(left, right, on, left_ts, right_ts, within, sums)
    amounts, keys = {n: _free(f"_{n}", left) for n in sums}, [f"k{i}" for i in range(len(on))]
    n, total = _free("_copies", left), lambda c: F.sum(c).over(Window.partitionBy(*keys, "b"))
    rows = _no_nulls(left, [*on, left_ts]).groupBy(*[F.col(f"`{c}`") for c in left.columns]).agg(F.count(F.lit(1)).alias(n))
    whole, span = F.struct(*[F.col(f"`{c}`") for c in rows.columns]), _micros(within)
    us, b = epoch_us(F.col(left_ts)), bucket_of(F.col(left_ts), within)
    # side 0: before right's rows (1) of its time; 2: after them
    mark = lambda at, side, bucket: F.struct(at.cast("long").alias("t"), F.lit(side).alias("side"), bucket.cast("long").alias("b"))
    marks = rows.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(on, keys, strict=True)], whole.alias("row"), F.explode(F.array(mark(us - span, 0, b - 1), mark(us, 3, b), mark(us + span, 2, b + 1))).alias("m"))
    kinds = {name: right.select(c.alias("c")).schema["c"].dataType for name, c in sums.items()}
    marks = marks.select(*keys, "row", "m.*", *[F.lit(0).cast(kinds[name]).alias(a) for name, a in amounts.items()])
    mine = _no_nulls(right, [*on, right_ts])
    mine = mine.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(on, keys, strict=True)], F.lit(None).cast(marks.schema["row"].dataType).alias("row"), epoch_us(F.col(right_ts)).alias("t"), F.lit(1).alias("side"), bucket_of(F.col(right_ts), within).alias("b"), *[F.coalesce(c, F.lit(0)).cast(kinds[name]).alias(amounts[name]) for name, c in sums.items()])
    past = Window.partitionBy(*keys, "b").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = marks.unionByName(mine).select("row", "side", *[F.when(F.col("side") == 0, total(a) - F.sum(a).over(past)).when(F.col("side") == 2, F.sum(a).over(past)).otherwise(total(a)).alias(a) for a in amounts.values()])
    out = found.where("row IS NOT NULL").groupBy("row").agg(*[F.sum(a).alias(name) for name, a in amounts.items()])
    out = out.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"row.`{n}`"))))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in left.columns], *sums)


def _near_sums_stream(left: DataFrame, right: DataFrame, on: Sequence[str], left_ts: str, right_ts: str, within: str, sums: Mapping[str, Column]) -> DataFrame:
    window, at, near, rows = (_free(n, left, right) for n in ("_window", "_at", "_near", "_rows"))
    keys, span = [_free(f"_k{i}", left, right) for i in range(len(on))], _micros(within)
    kinds = {name: right.select(c.alias("c")).schema["c"].dataType for name, c in sums.items()}
    amounts = [F.coalesce(c, F.lit(0)).cast(kinds[name]).alias(f"s{i}") for i, (name, c) in enumerate(sums.items())]
    three = F.window(right_ts, f"{3 * span} microseconds", f"{span} microseconds").alias(window)
    lists = _no_nulls(right, [*on, right_ts]).groupBy(three, *[F.col(f"`{c}`").alias(k) for c, k in zip(on, keys, strict=True)]).agg(F.collect_list(F.struct(epoch_us(F.col(right_ts)).alias("t"), *amounts)).alias(rows))
    lists = lists.select(*keys, F.window_time(window).alias(at), (bucket_of(F.col(f"{window}.start"), within) + 1).alias(near), rows)
    # the end of a window lies up to twice `within` after the rows of its middle; a left row waits for it, and as long again
    match = (F.col(near) == bucket_of(F.col(left_ts), within)) & (F.col(at) >= F.col(left_ts)) & (F.col(at) <= F.col(left_ts) + _interval(f"{4 * span} microseconds"))
    for c, k in zip(on, keys, strict=True):
        match &= F.col(c) == F.col(k)
    us = epoch_us(F.col(left_ts))
    none = F.struct(*[F.lit(0).cast(kind).alias(f"s{i}") for i, kind in enumerate(kinds.values())])
    close = F.filter(rows, lambda r: (r["t"] >= us - span) & (r["t"] <= us + span))
    total = F.aggregate(close, none, lambda a, r: F.struct(*[(a[f"s{i}"] + r[f"s{i}"]).cast(kind).alias(f"s{i}") for i, kind in enumerate(kinds.values())]))
    joined = _no_nulls(left, [*on, left_ts]).join(lists, match, "left")
    out = joined.select(*[F.col(f"`{c}`") for c in left.columns], F.coalesce(total, none).alias(rows))
    return out.select(*[F.col(f"`{c}`") for c in left.columns], *[F.col(f"{rows}.s{i}").alias(name) for i, name in enumerate(sums)])


def band_join(left: DataFrame, right: DataFrame, *, left_ts: str, right_ts: str, within: str, how: str = "left", prefix: str = "") -> DataFrame:
    """Pairs whose times differ by `within` at most, without a key: joined by time buckets, never by all pairs."""
    return interval_join(left, right, on=[], left_ts=left_ts, right_ts=right_ts, within=within, how=how, bucketed=True, prefix=prefix)


def correlate(audit: DataFrame, logs: DataFrame, *, keys: Sequence[str] = ("opcrequestid", "besttraceid"), audit_ts: str, log_ts: str, within: str, prefix: str = "audit_", watermark: str = "10 seconds") -> DataFrame:
    """Each log row with the audit rows that share its first key; log rows that match none by it are matched by the next key.

    Rows with a NULL key don't take part in that key's join. `matched_on` names the key. Time buckets join the keys, so that a busy key is many small groups.
    On streams (both sides; each waits for `watermark`) the rows that the first join gives up at the watermark feed the next one. There the audit rows of a key and bucket, which must fit in a row, are first put into lists, so that
    a log row meets three entries of state and not each row near it.
    """
    streams = audit.isStreaming and logs.isStreaming
    if streams:
        audit, logs = audit.withWatermark(audit_ts, watermark), logs.withWatermark(log_ts, watermark)
    matched, key, at, near, window, times, place = (_free(n, logs) for n in ("matched_on", "_key", "_at", "_near", "_window", "_times", "_place"))
    # a column each, not one struct: what isn't read after the join goes through none of its shuffles, states and pairs
    new, hit = ([_free(f"_{n}{i}", logs) for i in range(len(audit.columns))] for n in ("new", "hit"))
    # in a struct a time doesn't carry the watermark of its feed on
    whole = [F.struct(F.col(f"`{c}`").alias("v")) if c == audit_ts else F.col(f"`{c}`") for c in audit.columns]
    out = logs.withColumn(matched, F.lit(None).cast("string"))
    kept, first, last = list(logs.columns), F.col(log_ts) - _interval(within), F.col(log_ts) + _interval(within)
    if not (audit.isStreaming or logs.isStreaming):
        # once a row, as in interval_join
        ends = _free("_first", logs), _free("_last", logs)
        out, kept, first, last = out.select("*", first.alias(ends[0]), last.alias(ends[1])), [*kept, *ends], F.col(ends[0]), F.col(ends[1])
    near_by = lambda t: (t >= first) & (t <= last)
    deal = large(audit, logs)
    for k in keys:
        mine = audit.where(F.col(k).isNotNull())
        if streams:
            lists = mine.groupBy(F.window(audit_ts, within).alias(window), F.col(k).alias(key)).agg(F.collect_list(audit_ts).alias(times), *[F.collect_list(F.struct(v.alias("v"))).alias(n) for v, n in zip(whole, new, strict=True)])
            mine = lists.select(key, F.window_time(window).alias(at), F.explode(_near(F.col(f"{window}.start"), within)).alias(near), times, *new)
            # the end of a window lies up to `within` after its rows; a log row waits for it, and as long again
            close = (F.col(at) >= F.col(log_ts) - _interval(within)) & (F.col(at) <= F.col(log_ts) + _interval(f"{3 * _micros(within)} microseconds")) & F.exists(times, near_by)
        else:
            mine = mine.select(F.col(k).alias(key), F.col(audit_ts).alias(at), F.explode(_near(F.col(audit_ts), within)).alias(near), *[v.alias(n) for v, n in zip(whole, new, strict=True)])
            close = near_by(F.col(at))
        # rows that are matched already take part with a NULL key
        own, bucket = F.when(F.col(matched).isNull(), F.col(k)), bucket_of(F.col(log_ts), within)
        if deal:
            names = _free("_own", logs), _free("_bucket", logs)
            out, mine, own, bucket = _dealt(out.select("*", own.alias(names[0]), bucket.alias(names[1])), *names), _dealt(mine, key, near), F.col(names[0]), F.col(names[1])
        out = out.join(mine, (own == F.col(key)) & close & (bucket == F.col(near)), "left")
        if streams:
            places = F.filter(F.transform(times, lambda t, i: F.when(near_by(t), i)), lambda i: i.isNotNull())
            rest = [c for c in out.columns if c not in (*new, times)]
            out = out.select("*", F.explode_outer(places).alias(place)).select(*[F.col(f"`{c}`") for c in rest], *[F.get(n, F.col(place))["v"].alias(n) for n in new])
        before = [F.coalesce(h, n).alias(h) if h in out.columns else F.col(n).alias(h) for h, n in zip(hit, new, strict=True)]
        out = out.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(matched, F.when(F.col(key).isNotNull(), F.lit(k))).alias(matched), *before)
    found = [F.col(f"{h}.v" if c == audit_ts else h).alias(f"{prefix}{c}") for c, h in zip(audit.columns, hit, strict=True)]
    return out.where(F.col(matched).isNotNull()).select(*[F.col(f"`{c}`") for c in logs.columns], F.col(matched).alias("matched_on"), *found)


def lookup(view: DataFrame, **key_values: object) -> DataFrame:
    """The rows whose columns have the given values."""
    for name, value in key_values.items():
        view = view.where(F.col(f"`{name}`") == F.lit(value))
    return view
