"""Event-time-exact stateful operators on streams: as-of joins with any number of tables, and row patterns."""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from decimal import Decimal
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, DateType, DoubleType, FloatType, NumericType, StructType, TimestampNTZType, TimestampType

from ..functions.scalars import epoch_us
from ..operators.joins import _micros, version_order
from ..operators.patterns import Automaton, symbol_of

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A waiting row is the JSON text of its time, side, feed, ties, row and key.
_ROWS = "rows array<string>"
#: Keys are put into this many buckets by their hash: a stream's operator handles a bucket, not a key, at a time.
BUCKETS = 128
#: Rows that a slice of waiting rows should have; keys that a cell of a bucket's state should have.
SLICE_ROWS, CELL_KEYS = 2_000, 1_000
#: Rows of a bucket that are held at a time, where they come in and where they are due.
HELD_ROWS = 40_000


def _texts(col: Column, kind: DataType) -> Column:
    """A value whose parts are texts, from which _Typed reads them back exactly."""
    if isinstance(kind, StructType):
        return F.when(col.isNotNull(), F.struct(*[_texts(col[f.name], f.dataType).alias(f"f{i}") for i, f in enumerate(kind.fields)]))
    if isinstance(kind, ArrayType):
        return F.transform(col, lambda x: _texts(x, kind.elementType))
    if isinstance(kind, BinaryType):
        return F.hex(col)
    if isinstance(kind, DoubleType | FloatType):
        return col.cast("double").cast("string")
    if isinstance(kind, BooleanType):
        return col.cast("int").cast("string")
    if isinstance(kind, DateType):
        return F.unix_date(col).cast("string")
    if isinstance(kind, TimestampType | TimestampNTZType):
        return epoch_us(col).cast("string")
    return col.cast("string")


def _kind(kind: DataType) -> object:
    """How _value reads what _texts wrote: for structs and arrays by their parts. Intervals are ordered as text."""
    if isinstance(kind, StructType):
        return [_kind(f.dataType) for f in kind.fields]
    if isinstance(kind, ArrayType):
        return (_kind(kind.elementType),)
    if isinstance(kind, BinaryType):
        return "bytes"
    if isinstance(kind, DoubleType | FloatType):
        return "float"
    return "number" if isinstance(kind, NumericType | BooleanType | DateType | TimestampType | TimestampNTZType) else "text"


def _value(text: object, kind: object) -> tuple:
    """A sort key in Spark's order of the type: NULL first, NaN last."""
    if text is None:
        return (0,)
    if isinstance(kind, list):
        return 1, [_value(v, k) for v, k in zip(text.values(), kind, strict=True)]
    if isinstance(kind, tuple):
        return 1, [_value(v, kind[0]) for v in text]
    if kind == "bytes":
        return 1, bytes.fromhex(text)
    if kind == "float":
        x = float(text)
        return 1, math.isnan(x), 0.0 if math.isnan(x) else x
    return 1, Decimal(text) if kind == "number" else text


class _Ordered(StatefulProcessor):
    """Holds a bucket's rows until the watermark has passed them, and hands them on by key in order.

    Rows wait in a map by time slice and chunk (a slice's rows of up to HELD_ROWS that came in), beside an index of the slices. A timer, one a bucket, reads and
    deletes the chunks of the slices that are due; of the slice that the watermark is in, the rest is written back. All other slices are left alone.
    Slices are read by their least times, and handed on to `step` some HELD_ROWS at a time, so that a bucket of many rows isn't held whole.
    kinds: for each feed how its ties are read. slice_us: the length of slices; by default a power of two, for each chunk as many microseconds as give slices of about SLICE_ROWS rows.
    """

    def __init__(self, kinds: Sequence[list], slice_us: int | None = None):
        self.kinds, self.slice_us = list(kinds), slice_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slice long, chunk int", _ROWS)
        self.index = handle.getValueState("index", "slices array<struct<slice: long, chunks: int, least: long>>")
        self.due = handle.getValueState("due", "ms long")

    def slices(self) -> dict[int, list[int]]:
        """[chunks, least time] of each slice."""
        return {s[0]: [s[1], s[2]] for s in self.index.get()[0]} if self.index.exists() else {}

    def wait(self, slices: dict[int, list[int]], rows: Sequence[tuple], seen: int = 0) -> None:
        """Writes rows (time first) to their slices. seen: how many rows of the bucket came in with them; slices are the shorter, to 1/20."""
        if self.slice_us:
            number = lambda t: t // self.slice_us
        else:
            times = sorted(r[0] for r in rows)
            middle = times[len(times) * 9 // 10] - times[len(times) // 10]
            many = max(len(times), min(seen, 20 * len(times)))
            level = min(62, max(20, (middle * SLICE_ROWS // many).bit_length()))
            number = lambda t: (t >> level) * 64 + level
        of: dict[int, list[tuple]] = {}
        for r in rows:
            of.setdefault(number(r[0]), []).append(r)
        for at, part in of.items():
            least = min(r[0] for r in part)
            about = slices.setdefault(at, [0, least])
            self.waiting.updateValue((at, about[0]), ([json.dumps(r) for r in part],))
            slices[at] = [about[0] + 1, min(about[1], least)]

    def keep(self, slices: dict[int, list[int]]) -> None:
        """Writes the index, and sets the bucket's timer to when the watermark passes its earliest waiting row."""
        if slices:
            self.index.update(([(s, *about) for s, about in slices.items()],))
        elif self.index.exists():
            self.index.clear()
        ms = min((least // 1000 + 1 for _, least in slices.values()), default=None)
        before = self.due.get()[0] if self.due.exists() else None
        if ms == before:
            return
        if before is not None:
            self.handle.deleteTimer(before)
        if ms is None:
            self.due.clear()
        else:
            self.handle.registerTimer(ms)
            self.due.update((ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        slices, held, seen = self.slices(), [], 0
        for frame in rows:
            cols = [frame[c].tolist() for c in ("t", "side", "feed", "tie", "row")]
            held.extend(zip(*cols, frame["key"].tolist() if "key" in frame else [""] * len(frame), strict=True))
            seen += len(frame)
            if len(held) >= HELD_ROWS:
                self.wait(slices, held, seen)
                held = []
        if held:
            self.wait(slices, held, seen)
        self.keep(slices)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.due.clear()
        until, slices = timerValues.getCurrentWatermarkInMs() * 1000, self.slices()
        due = sorted((least, at) for at, (_, least) in slices.items() if least < until)
        rest, self.later, most = [], [], HELD_ROWS
        for i, (_, at) in enumerate(due):
            for chunk in range(slices.pop(at)[0]):
                rest.extend(tuple(json.loads(r)) for r in self.waiting.getValue((at, chunk))[0])
                self.waiting.removeKey((at, chunk))
            last = i + 1 == len(due)
            if last or len(rest) >= most:
                # all rows before the next slice's least time are read: for them it is as if the watermark were there
                to = until if last else min(until, due[i + 1][0])
                rest, ready = [r for r in rest if r[0] >= to], [r for r in rest if r[0] < to]
                out = self.step(self.sorted(ready), to)
                rest, self.later = rest + self.later, []
                most = max(HELD_ROWS, 2 * len(rest))
                if len(out):
                    yield out
        if rest:
            self.wait(slices, rest)
        self.keep(slices)

    def sorted(self, rows: list[tuple]) -> list[tuple]:
        """rows by key, time and side; ties by their typed values, which are read only where there are any."""
        before = lambda r: (r[5], r[0], r[1], r[2])
        out: list[tuple] = []
        for _, same in groupby(sorted(rows, key=before), key=before):
            tied = list(same)
            out.extend(sorted(tied, key=self.tie) if len(tied) > 1 else tied)
        return out

    def tie(self, row: tuple) -> list:
        values = json.loads(row[3]).values() if row[3] else ()
        return [_value(v, kind) for v, kind in zip(values, self.kinds[row[2]], strict=True)]

    def step(self, ready: list[tuple], until: int) -> pd.DataFrame:
        """Rows to emit for rows in order. until: the watermark. Rows that are put to self.later wait in their turn."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Cells:
    """A bucket's values by key, as JSON texts of cells of some CELL_KEYS keys each; only the cells of the keys in use are read, and those of changed keys written."""

    def __init__(self, handle: StatefulProcessorHandle, name: str):
        self.cells = handle.getMapState(name, "cell int", "held string")
        self.size = handle.getValueState(f"{name}_size", "cells int, keys long")

    def open(self, keys: Iterable[str]) -> dict[str, object]:
        """The values of those of the keys that have any."""
        self.n, self.keys = self.size.get() if self.size.exists() else (1, 0)
        self.held = {cell: self.read(cell) for cell in {self.cell(k) for k in keys}}
        return {k: held[k] for k in keys if k in (held := self.held[self.cell(k)])}

    def cell(self, key: str) -> int:
        return zlib.crc32(key.encode()) % self.n

    def read(self, cell: int) -> dict[str, object]:
        return json.loads(self.cells.getValue((cell,))[0]) if self.cells.containsKey((cell,)) else {}

    def write(self, changed: Mapping[str, object]) -> None:
        """Writes values of keys that were opened; None takes a key away."""
        before = self.keys
        for key, value in changed.items():
            held = self.held[self.cell(key)]
            self.keys += (value is not None) - (key in held)
            if value is not None:
                held[key] = value
            elif key in held:
                del held[key]
        touched = {self.cell(k) for k in changed}
        if self.keys > CELL_KEYS * self.n:
            every = [item for cell in range(self.n) for item in (self.held[cell] if cell in self.held else self.read(cell)).items()]
            self.n *= 1 << (self.keys // (CELL_KEYS * self.n)).bit_length()
            self.held, touched, before = {cell: {} for cell in range(self.n)}, set(range(self.n)), None
            for key, value in every:
                self.held[self.cell(key)][key] = value
        for cell in touched:
            if self.held[cell]:
                self.cells.updateValue((cell,), (json.dumps(self.held[cell]),))
            elif self.cells.containsKey((cell,)):
                self.cells.removeKey((cell,))
        if self.keys != before:
            self.size.update((self.n, self.keys))


class _AsOf(_Ordered):
    """Facts (side 1) with the current version of each feed. State: by key the versions, one a feed, and what waits."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.current = _Cells(handle, "current")

    def step(self, ready, until):
        current = self.current.open({r[5] for r in ready})
        none, times, facts, versions, changed = [None] * (len(self.kinds) - 1), [], [], [], {}
        for t, side, feed, _, row, key in ready:
            now = current.get(key, none)
            if side:
                times.append(t)
                facts.append(row)
                versions.append(now)
            else:
                current[key] = changed[key] = [*now[:feed], row, *now[feed + 1 :]]
        self.current.write(changed)
        return pd.DataFrame({"at": pd.to_datetime(times, unit="us", utc=True), "fact": facts, "versions": versions})


_TIME = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _json(*cols: Column) -> Column:
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false", **_TIME})


def _ordered(df: DataFrame, keys: Sequence[str], ts: str, side: int, feed: int, tie: Sequence[str], watermark: str | None, event_time: str | None = None, mark: Column | None = None) -> tuple[DataFrame, list]:
    """The rows of df that have a key and a time, for _Ordered, and how their ties (of columns) are read. event_time: the column that carries df's watermark. mark: a letter before the row."""
    whole = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*keys, ts]))
    if watermark:
        whole = whole.withWatermark(event_time or ts, watermark)
    ties = _json(*[_texts(F.col(f"`{c}`"), df.schema[c].dataType).alias(f"c{i}") for i, c in enumerate(tie)]) if tie else F.lit("")
    row = _json(*[F.col(f"`{c}`") for c in df.columns if c != event_time or c == ts])
    row = row if mark is None else F.concat(mark, row)
    rows = whole.select(_json(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]).alias("key"), F.col(event_time or ts).alias("_time"), epoch_us(F.col(ts)).alias("t"), F.lit(side).alias("side"), F.lit(feed).alias("feed"), ties.alias("tie"), row.alias("row"))
    return rows, [_kind(df.schema[c].dataType) for c in tie]


def _by_bucket(rows: DataFrame, buckets: int) -> GroupedData:
    """rows of _ordered by buckets of keys. A call of state costs far more than a row, so keys share them."""
    return rows.withColumn("_bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("_bucket")


def asof_enrich_stream(fact: DataFrame, tables: Mapping[str, tuple[DataFrame, str] | tuple[DataFrame, str, str]], *, on: Sequence[str], ts: str, tiebreak: str | None = None, watermark: str | None = "10 seconds", slice_us: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """asof_enrich on streams: fact with, for each change feed, a struct column of its version that was current at `ts`. One keyed operator for all feeds, exact in event time.

    tables: (feed, version column), or (feed, version column, event-time column) for the result of another stateful operator, whose event time carries its
    watermark and isn't part of the version: for windows the version column is the window's end, and the event time F.window_time of the window.
    A fact waits until the watermark has passed it. Versions of equal time are ordered as in asof_enrich. Facts with a NULL key or time come through at once, without versions.
    State per key: facts and versions after the watermark, in slices of time, and one version a feed before it. `ts` of the result carries the watermark on, for windows over it.
    watermark: None if fact and the feeds have theirs. buckets: of keys, fixed for a checkpoint; a bucket's rows go through some HELD_ROWS at a time. Sessions need the RocksDB state store (ROCKSDB). Rows behind the watermark are dropped: see late_rows.
    """
    every, _ = _ordered(fact, on, ts, 1, len(tables), [], watermark)
    kinds, schemas = [], []
    for i, (df, version, *event_time) in enumerate(tables.values()):
        own = [c for c in df.columns if c not in event_time]
        rows, kind = _ordered(df, on, version, 0, i, version_order(df.select(*[F.col(f"`{c}`") for c in own]), tiebreak), None if event_time else watermark, *event_time)
        every = every.unionByName(rows)
        kinds.append(kind)
        schemas.append(StructType([f for f in df.schema if f.name in own]))
    joined = _by_bucket(every, buckets).transformWithStateInPandas(_AsOf([*kinds, []], slice_us), "at timestamp, fact string, versions array<string>", "append", "eventtime", eventTimeColumnName="at")
    rows = joined.select("at", F.from_json("fact", fact.schema, _TIME).alias("fact"), *[F.from_json(F.get("versions", F.lit(i)), schema, _TIME).alias(f"v{i}") for i, schema in enumerate(schemas)])
    time = F.col("at") if isinstance(fact.schema[ts].dataType, TimestampType) else F.col(f"fact.`{ts}`")
    found = rows.select(*[(time if c == ts else F.col(f"fact.`{c}`")).alias(c) for c in fact.columns], *[F.col(f"v{i}").alias(n) for i, n in enumerate(tables)])
    lost = fact.where(" OR ".join(f"`{c}` IS NULL" for c in [*on, ts]))
    return found.unionByName(lost.select(*[F.col(f"`{c}`") for c in fact.columns], *[F.lit(None).cast(schema).alias(n) for n, schema in zip(tables, schemas, strict=True)]))


def asof_stream(left: DataFrame, right: DataFrame, *, on: Sequence[str], left_ts: str, right_ts: str, how: str = "left", tiebreak: str | None = None, watermark: str | None = "10 seconds", prefix: str = "", event_time: str | None = None, slice_us: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """asof_join on streams, exact in event time: asof_enrich_stream with one table. event_time: right's event-time column, if it is not the version itself."""
    if how not in ("left", "inner"):
        raise ValueError(f"how is left or inner, not {how}")
    table = (right, right_ts, event_time) if event_time else (right, right_ts)
    out = asof_enrich_stream(left, {"_version": table}, on=on, ts=left_ts, tiebreak=tiebreak, watermark=watermark, slice_us=slice_us, buckets=buckets)
    if how == "inner":
        out = out.where("_version IS NOT NULL")
    return out.select(*[F.col(f"`{c}`") for c in left.columns], *[F.col(f"_version.`{c}`").alias(f"{prefix}{c}") for c in right.columns if c not in (*on, event_time)])


class _Pattern(_Ordered):
    """A, one or more L, F: of a key's past only the open run from its A on is kept."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.runs = _Cells(handle, "runs")

    def step(self, ready, until):
        runs, out, changed = self.runs.open({r[5] for r in ready}), [], {}
        for key, own in groupby(ready, key=lambda r: r[5]):
            run = runs.get(key, [])
            for r in own:
                symbol, row = r[4][0], r[4][1:]
                if symbol == "A" or symbol == "L" and run:
                    run = [row] if symbol == "A" else [run[0], row]
                else:
                    if symbol == "F" and len(run) == 2:
                        out.append((run[1], row))
                    run = []
            if run or key in runs:
                changed[key] = run or None
        self.runs.write(changed)
        return pd.DataFrame(out, columns=["l", "f"])


def match_stream(df: DataFrame, *, by: Sequence[str], ts: str, tiebreak: str, a: Column, l: Column, f: Column, measures: Callable[[Column, Column], Sequence[Column]], watermark: str = "10 seconds", buckets: int = BUCKETS) -> DataFrame:  # noqa: E741
    """match_a_lplus_f on a stream: a match is emitted once the watermark has passed its F row.

    measures: from the structs of the last L row and the F row, the columns of a match. State per key: rows after the
    watermark, and the open run's first and last row.
    """
    symbol = F.when(a, "A").when(l, "L").when(f, "F").otherwise("X")
    rows, kind = _ordered(df, by, ts, 0, 0, [tiebreak], watermark, mark=symbol)
    found = _by_bucket(rows, buckets).transformWithStateInPandas(_Pattern([kind]), "l string, f string", "append", "eventtime")
    both = found.select(F.from_json("l", df.schema, _TIME).alias("l"), F.from_json("f", df.schema, _TIME).alias("f"))
    return both.select(*measures(F.col("l"), F.col("f")))


class _Longest(_Ordered):
    """Longest matches from each row, by an automaton.

    State by key: the number of rows so far, the last one's time, whether a reminder (side 2) waits for the time when the key is idle, and open matches in bundles that
    share the automaton's state and the row with which they were last whole.
    """

    def __init__(self, kinds: Sequence[list], automaton: Automaton, idle_us: int | None):
        super().__init__(kinds)
        self.automaton, self.idle_us = automaton, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = _Cells(handle, "open")

    def step(self, ready, until):
        state, out = self.open.open({r[5] for r in ready}), []
        self.open.write({key: self.follow(key, list(own), until, state.get(key, [0, 0, False, []]), out) for key, own in groupby(ready, key=lambda r: r[5])})
        return pd.DataFrame(out, columns=["first", "last", "rows"])

    def follow(self, key: str, rows: list[tuple], until: int, state: list, out: list[tuple]) -> list:
        """A key's state after its rows."""
        steps, accepts = self.automaton.steps, self.automaton.accepts
        seen, t, reminded, bundles = state

        def close(bundle: list) -> None:
            _, last, at, starts = bundle
            if last is not None:
                out.extend((row, last, at - begun + 1) for row, begun in starts)

        def close_all() -> list:
            for bundle in bundles:
                close(bundle)
            return []

        for r in rows:
            if r[1] == 2:
                reminded = False
                continue
            if self.idle_us is not None and r[0] > t + self.idle_us:
                bundles = close_all()
            symbol, row, t = r[4][0], r[4][1:], r[0]
            seen += 1
            whole: dict[int, list] = {}
            going = []
            for bundle in [*bundles, [0, None, 0, [(row, seen)]]]:
                to = steps[bundle[0]].get(symbol)
                if to is None:
                    close(bundle)
                elif accepts[to]:
                    whole.setdefault(to, []).extend(bundle[3])
                else:
                    going.append([to, *bundle[1:]])
            bundles = going + [[to, row, seen, starts] for to, starts in whole.items()]
            for bundle in [b for b in bundles if not steps[b[0]]]:
                close(bundle)
                bundles.remove(bundle)
        if self.idle_us is not None and until > t + self.idle_us:
            bundles = close_all()
        if self.idle_us is not None and bundles and not reminded:
            self.later.append((t + self.idle_us, 2, 0, "", "", key))
            reminded = True
        return [seen, t, reminded, bundles]


def match_longest_stream(df: DataFrame, *, by: Sequence[str], ts: str, tiebreak: Sequence[str], defines: Mapping[str, Column], pattern: str, watermark: str = "10 seconds", idle: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """match_longest on a stream: by, `first`, `last` and `rows` of the longest match from each row, once the watermark has passed the row that ends it.

    A match that more rows could make longer stays open until its key's next row; idle: or until the watermark is so far past the key's last row, which ends it as a row without a symbol would (rows so far apart are then not one match).
    State per key: rows after the watermark, and the first rows of open matches. Rows without key or time are left out. Sessions need the RocksDB state store.
    """
    rows, kind = _ordered(df, by, ts, 0, 0, tiebreak, watermark, mark=symbol_of(defines))
    processor = _Longest([kind], Automaton.of(pattern), None if idle is None else _micros(idle))
    found = _by_bucket(rows, buckets).transformWithStateInPandas(processor, "first string, last string, rows long", "append", "eventtime")
    both = found.select(F.from_json("first", df.schema, _TIME).alias("first"), F.from_json("last", df.schema, _TIME).alias("last"), "rows")
    return both.select(*[F.col(f"first.`{c}`").alias(c) for c in by], "first", "last", "rows")


def snapshot_join(facts: DataFrame, current: DataFrame, *, on: Sequence[str], prefix: str = "") -> DataFrame:
    """A stream (or micro-batch) with the present row of each key of a table: by arrival, not event time.

    In foreachBatch, read the table anew for each batch.
    """
    others = [c for c in current.columns if c not in on]
    return facts.join(current.select(*on, *[F.col(c).alias(f"{prefix}{c}") for c in others]), list(on), "left")


def latest_stream(df: DataFrame, keys: Sequence[str], version_cols: Sequence[str]) -> DataFrame:
    """The latest row of each key, as a stream in update mode."""
    row = F.struct(*version_cols, *[c for c in df.columns if c not in version_cols])
    return df.groupBy(*keys).agg(F.max(row).alias("_row")).select(*[f"_row.`{c}`" for c in df.columns])
