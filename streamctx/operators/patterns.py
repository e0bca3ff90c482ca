"""Ordered row patterns within a partition."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType
from pyspark.sql.window import Window

from ..functions.scalars import epoch_us
from .joins import _micros


def match_a_lplus_f(df: DataFrame, *, by: Sequence[str], order: Sequence[str], a: Column, l: Column, f: Column, measures: Mapping[str, Column | tuple[str, Column]]) -> DataFrame:  # noqa: E741
    """One row for each match of A, one or more L, F in unbroken sequence; matches may share rows (skip to the next row).

    a, l and f must exclude one another. order must be total, with a tie-breaker for equal times.
    measures: a column of the F row, or ("last_l", column) for the last L row's. One shuffle, one sort, no Python.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.withColumn("_s", F.when(a, "A").when(l, "L").when(f, "F").otherwise("X"))
    last = {n: m[1] for n, m in measures.items() if isinstance(m, tuple)}
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", F.lag("_s").over(w).alias("_p"), F.last(F.when(F.col("_s") != "L", F.col("_s")), ignorenulls=True).over(before).alias("_q"), *[F.lag(c).over(w).alias(f"_m_{n}") for n, c in last.items()])
    hit = rows.where("_s = 'F' AND _p = 'L' AND _q = 'A'")
    return hit.select(*by, *[F.col(f"_m_{n}").alias(n) if n in last else m.alias(n) for n, m in measures.items()])


def match_sequence(df: DataFrame, *, by: Sequence[str], order: Sequence[str], defines: Mapping[str, Column], pattern: str, measures: Callable[[pd.DataFrame, str], dict], out_schema: str) -> DataFrame:
    """One row for each start from which a pattern of one-letter symbols (`A`, `L+`, `F`, `*`, `?`) matches unbroken rows, longest first.

    defines: the condition of each symbol, the first that holds counts. measures: from a match's rows and their
    symbols, the values of the row besides `by`. Rows without a symbol end every match, so Spark cuts a partition's order there, and only runs of rows that
    have symbols go to Python; one such run must fit in one task's memory.
    """
    symbol = symbol_of(defines)
    compiled = re.compile("".join(pattern.split()))

    def scan(rows: pd.DataFrame) -> list[dict]:
        """The matches of a run, whose rows are in order."""
        text, out = "".join(rows["_s"]), []
        for at in range(len(text)):
            m = compiled.match(text, at)
            if m and m.end() > at:
                part = rows.iloc[at : m.end()]
                out.append({**{k: part[k].iloc[0] for k in by}, **measures(part, m.group())})
        return out

    def scan_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The matches of sorted runs: many to a frame, and a frame's last one may go on in the next."""
        open_run: list[pd.DataFrame] = []
        names = [c.split()[0] for c in out_schema.split(",")]
        for frame in chain(frames, [None]):
            out: list[dict] = []
            if frame is None:
                if open_run:
                    out += scan(pd.concat(open_run, ignore_index=True))
            elif len(frame):
                frame = frame.reset_index(drop=True)
                begins = [i for i, first in enumerate(frame["_first"].tolist()) if first]
                until = begins[0] if begins else len(frame)
                if until:
                    open_run.append(frame.iloc[:until])
                if begins:
                    if open_run:
                        out += scan(pd.concat(open_run, ignore_index=True))
                    text = "".join(frame["_s"])
                    for a, b in zip(begins, begins[1:]):
                        # most runs hold no match: only those that do are cut out
                        if compiled.search(text[a:b]):
                            out += scan(frame.iloc[a:b])
                    open_run = [frame.iloc[begins[-1] :]]
            if out:
                yield pd.DataFrame(out, columns=names)

    in_order = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumn("_s", symbol).withColumn("_run", F.count(F.when(F.col("_s") == "_", 1)).over(in_order)).where("_s <> '_'")
    # runs begin where the one before ended; the window leaves each key's rows together and in order
    runs = Window.partitionBy(*by).orderBy(*order)
    first = F.lag("_run").over(runs)
    return rows.withColumn("_first", first.isNull() | (first != F.col("_run"))).mapInPandas(scan_all, out_schema)


@dataclass(frozen=True)
class Automaton:
    """The deterministic automaton of a pattern of one-letter symbols, each plain or with `+`, `*` or `?`. State 0 begins; a missing step ends the match."""

    steps: tuple[dict[str, int], ...]
    accepts: tuple[bool, ...]

    @classmethod
    def of(cls, pattern: str) -> Automaton:
        text = "".join(pattern.split())
        if not re.fullmatch(r"(?:[A-Za-z][+*?]?)+", text):
            raise ValueError(f"no pattern of symbols: {pattern}")
        units = []
        for symbol, count in re.findall(r"([A-Za-z])([+*?]?)", text):
            units += {"": [(symbol, "one")], "?": [(symbol, "opt")], "*": [(symbol, "many")], "+": [(symbol, "one"), (symbol, "many")]}[count]

        def closed(places: set[int]) -> frozenset[int]:
            out = set()
            for place in places:
                out.add(place)
                while place < len(units) and units[place][1] != "one":
                    place += 1
                    out.add(place)
            return frozenset(out)

        number, steps = {closed({0}): 0}, []
        for places in (todo := [closed({0})]):
            of: dict[str, set[int]] = {}
            for place in places:
                if place < len(units):
                    symbol, count = units[place]
                    of.setdefault(symbol, set()).add(place if count == "many" else place + 1)
            steps.append({})
            for symbol, reached in sorted(of.items()):
                to = closed(reached)
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                steps[-1][symbol] = number[to]
        return cls(tuple(steps), tuple(len(units) in places for places in number))

    def run(self, symbols: Sequence[str], state: int) -> tuple[int, int]:
        """From a state over symbols: the state at their end (-1 if the match ended) and the place of the last symbol with which it was whole (-1 if none)."""
        last = -1
        for at, symbol in enumerate(symbols):
            state = self.steps[state].get(symbol, -1)
            if state < 0:
                break
            if self.accepts[state]:
                last = at
        return state, last

    def ends(self, symbols: Sequence[str], after: Sequence[int | None]) -> list[int | None]:
        """For each place the end of the longest match that begins there; from right to left, so each symbol is looked at once a state. after: the ends that lie behind the symbols, for each state at their end."""
        now, out = list(after), [None] * len(symbols)
        for at in range(len(symbols) - 1, -1, -1):
            before = []
            for step in self.steps:
                to = step.get(symbols[at])
                before.append(None if to is None else now[to] if now[to] is not None else at if self.accepts[to] else None)
            now = before
            out[at] = now[0]
        return out


def symbol_of(defines: Mapping[str, Column]) -> Column:
    """The first symbol whose condition holds; `_` if none does."""
    symbol = F.lit("_")
    for name, condition in reversed(defines.items()):
        symbol = F.when(condition, name).otherwise(symbol)
    return symbol


def match_longest(df: DataFrame, *, by: Sequence[str], ts: str, tiebreak: Sequence[str], defines: Mapping[str, Column], pattern: str, time_slice: str = "1 day") -> DataFrame:
    """by, `first` and `last` (the rows of a match's ends, as structs) and `rows`, for the longest match from each row that a match begins with.

    Rows are ordered by ts and tiebreak, which should be total (NULL first). A key's rows are taken in slices of time, each a task's: first each slice is summed up as what it does to a match that
    comes in, in any state of the pattern's automaton (where it ends, or in which state it goes on); a key's sums are folded from the last slice to the first; then each
    slice finds the ends of its own matches, which may lie in later slices. So a run of any length is many tasks; a slice of a key must fit in one. Many slices share a call of Python.
    """
    automaton = Automaton.of(pattern)
    states, keys = range(len(automaton.steps)), [f"k{i}" for i in range(len(by))]
    slices = F.coalesce(F.floor(epoch_us(F.col(ts)) / _micros(time_slice)), F.lit(-(1 << 62))).alias("slice")
    rows = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)], slices, symbol_of(defines).alias("symbol"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    in_time = [F.col(f"row.`{ts}`"), *[F.col(f"row.`{c}`") for c in tiebreak]]
    of_slice = Window.partitionBy(*keys, "slice")
    of_key = StructType([rows.schema[k] for k in keys])
    summed = StructType([*of_key, *StructType().add("slice", LongType()).add("n", LongType()).add("state", IntegerType()).add("exit", IntegerType()).add("at", LongType()).add("row", df.schema)])

    def sum_up(table: pa.Table, groups: list[tuple[int, int]]) -> pa.Table:
        symbols, firsts, ns, exits, ats, ends = table["symbol"].to_pylist(), [], [], [], [], []
        for a, b in groups:
            own = symbols[a:b]
            for q in states:
                out, at = automaton.run(own, q)
                firsts.append(a)
                ns.append(b - a)
                exits.append(out)
                ats.append(at if at >= 0 else None)
                ends.append(a + at if at >= 0 else None)
        same = _taken(table, [*keys, "slice"], firsts)
        columns = {"n": pa.array(ns, pa.int64()), "state": pa.array([*states] * len(groups), pa.int32()), "exit": pa.array(exits, pa.int32()), "at": pa.array(ats, pa.int64()), "row": table["row"].combine_chunks().take(pa.array(ends, pa.int64()))}
        for name, value in columns.items():
            same = same.append_column(name, value)
        return same

    ahead = StructType([*of_key, *StructType().add("slice", LongType()).add("state", IntegerType()).add("rest", LongType()).add("row", df.schema)])

    def fold(table: pa.Table, groups: list[tuple[int, int]]) -> pa.Table:
        """For each slice and state, the end (a row of the sums) of a match that leaves the slice in it, and how many rows later."""
        exits, ats, ns = (table[c].to_pylist() for c in ("exit", "at", "n"))
        takes, kept = [], []
        for a, b in groups:
            later: list[tuple[int, int] | None] = [None] * len(states)
            for first in range(a, b, len(states)):
                for q in states:
                    if later[q] is not None:
                        takes.append(later[q])
                        kept.append(first + q)
                now = []
                for q in states:
                    out, at = exits[first + q], ats[first + q]
                    goes_on = later[out] if out >= 0 else None
                    now.append((goes_on[0], goes_on[1] + ns[first]) if goes_on is not None else None if at is None else (first + q, at))
                later = now
        out = _taken(table, [*keys, "slice", "state"], kept)
        return out.append_column("rest", pa.array([rest for _, rest in takes], pa.int64())).append_column("row", table["row"].combine_chunks().take(pa.array([i for i, _ in takes], pa.int64())))

    found = StructType([*of_key, *StructType().add("first", df.schema).add("last", df.schema).add("rows", LongType())])

    def find(table: pa.Table, groups: list[tuple[int, int]]) -> pa.Table:
        """A slice's first rows are the ends that lie behind it, with their states."""
        symbols, qs, rests = (table[c].to_pylist() for c in ("symbol", "state", "rest"))
        begins, lasts, lengths = [], [], []
        for a, b in groups:
            own = next((i for i in range(a, b) if qs[i] is None), b)
            n, after, source = b - own, [None] * len(states), {}
            for i in range(a, own):
                after[qs[i]] = n + rests[i]
                source[n + rests[i]] = i
            for at, end in enumerate(automaton.ends(symbols[own:b], after)):
                if end is not None:
                    begins.append(own + at)
                    lasts.append(source.get(end, own + end))
                    lengths.append(end - at + 1)
        out, every = _taken(table, keys, begins), table["row"].combine_chunks()
        for name, value in {"first": every.take(pa.array(begins, pa.int64())), "last": every.take(pa.array(lasts, pa.int64())), "rows": pa.array(lengths, pa.int64())}.items():
            out = out.append_column(name, value)
        return out

    sums = rows.withColumn("i", F.row_number().over(of_slice.orderBy(*in_time))).mapInArrow(_of_groups(sum_up), summed)
    ends = sums.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("slice"), "state"))).mapInArrow(_of_groups(fold), ahead)
    none = lambda kind: F.lit(None).cast(kind)
    both = rows.select("*", none("int").alias("state"), none("long").alias("rest")).unionByName(ends.withColumn("symbol", none("string")))
    out = both.withColumn("i", F.row_number().over(of_slice.orderBy(F.asc_nulls_last("state"), *in_time))).mapInArrow(_of_groups(find), found)
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], "first", "last", "rows")


def _taken(table: pa.Table, names: Sequence[str], at: Sequence[int]) -> pa.Table:
    return table.select(names).combine_chunks().take(pa.array(at, pa.int64()))


def _of_groups(work: Callable[[pa.Table, list[tuple[int, int]]], pa.Table], rows: int = 20_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: work on whole groups of sorted rows, some `rows` at a time (more only if one group has them), with the places where each begins and ends. Column i numbers a group's rows from 1."""

    def groups(table: pa.Table) -> Iterator[pa.RecordBatch]:
        begins = np.flatnonzero(table["i"].to_numpy() == 1).tolist()
        yield from work(table, list(zip(begins, [*begins[1:], table.num_rows], strict=True))).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, enough = 0, rows
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < enough:
                continue
            table = pa.Table.from_batches(held)
            cut = int(np.flatnonzero(table["i"].to_numpy() == 1)[-1])
            if cut:
                yield from groups(table.slice(0, cut))
                held, n = table.slice(cut).to_batches(), n - cut
            enough = max(rows, 2 * n)
        if n:
            yield from groups(pa.Table.from_batches(held))

    return run
