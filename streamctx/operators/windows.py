"""Windowed aggregates, latest rows, top-k, ordered lists."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import _micros

#: An aggregate of windows, whole or merged from panes: its kind (a name in _KINDS) and its column.
Part = tuple[str, Column]


class _Kind(NamedTuple):
    """direct: over a window's rows; of_pane: what a pane holds; merged: over the panes of a window."""

    direct: Callable[[Column], Column]
    of_pane: Callable[[Column], Column]
    merged: Callable[[Column], Column]


def _moments(col: Column) -> Column:
    """Count, mean and sum of squared distances from it."""
    x = col.cast("double")
    return F.struct(F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"))


def _pooled(panes: Column) -> Column:
    """The moments of several panes' rows: a window has a fixed number of panes. Squares of large means are never subtracted."""
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def add(a: Column, b: Column) -> Column:
        n, gap = a["n"] + b["n"], b["mean"] - a["mean"]
        return F.struct(n.alias("n"), (a["mean"] + gap * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + gap * gap * a["n"] * b["n"] / n).alias("m2"))

    return F.aggregate(F.filter(F.collect_list(panes), lambda p: p["n"] > 0), none, add)


def _mean(panes: Column) -> Column:
    m = _pooled(panes)
    return F.when(m["n"] > 0, m["mean"])


def _stddev(panes: Column) -> Column:
    m = _pooled(panes)
    return F.when(m["n"] > 1, F.sqrt(m["m2"] / (m["n"] - 1)))


_KINDS = {
    "sum": _Kind(F.sum, F.sum, F.sum),
    "count": _Kind(F.count, F.count, F.sum),
    "max": _Kind(F.max, F.max, F.max),
    "min": _Kind(F.min, F.min, F.min),
    "avg": _Kind(lambda c: F.avg(c.cast("double")), _moments, _mean),
    "stddev": _Kind(lambda c: F.stddev_samp(c.cast("double")), _moments, _stddev),
    # exact, by sets of values; and by sketches of fixed size
    "distinct": _Kind(lambda c: F.size(F.collect_set(c)).cast("long"), F.collect_set, lambda sets: F.size(F.array_distinct(F.flatten(F.collect_list(sets)))).cast("long")),
    "approx_distinct": _Kind(lambda c: F.hll_sketch_estimate(F.hll_sketch_agg(c)), F.hll_sketch_agg, lambda c: F.hll_sketch_estimate(F.hll_union_agg(c))),
}


def tumble_agg(df: DataFrame, keys: Sequence[str], size: str, aggs: Sequence[Column], *, ts: str = "event_time", watermark: str | None = None, window_col: str | None = None) -> DataFrame:
    """window_start, window_end, keys and the aggregates of each tumbling window. window_col: also the window itself, which on streams carries the watermark on to a next stateful operator."""
    return _windowed(df, keys, F.window(ts, size), aggs, ts, watermark, window_col)


def _windowed(df: DataFrame, keys: Sequence[str], window: Column, aggs: Sequence[Column], ts: str, watermark: str | None, window_col: str | None = None) -> DataFrame:
    if watermark and df.isStreaming:
        df = df.withWatermark(ts, watermark)
    out = df.groupBy(window.alias("_w"), *keys).agg(*aggs)
    whole = [F.col("_w").alias(window_col)] if window_col else []
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *whole, *[c for c in out.columns if c != "_w"])


def hop_agg(df: DataFrame, keys: Sequence[str], size: str, slide: str, aggs: Mapping[str, Part], *, ts: str = "event_time", watermark: str | None = None, panes: bool = False, window_col: str | None = None) -> DataFrame:
    """window_start, window_end, keys and the aggregates of each hopping window. window_col (without panes): as in tumble_agg.

    Kinds: sum, count, max, min, avg and stddev (of a sample) as doubles, distinct (exact) and approx_distinct (a sketch). panes (batch): rows are first aggregated to panes of `slide`, and panes, not rows, are copied to
    the windows they lie in; size must be a multiple of slide.
    """
    direct = [_KINDS[kind].direct(col).alias(name) for name, (kind, col) in aggs.items()]
    if not panes:
        return _windowed(df, keys, F.window(ts, size, slide), direct, ts, watermark, window_col)
    n, rest = divmod(_micros(size), _micros(slide))
    if rest:
        raise ValueError(f"{size} is not a multiple of {slide}")
    pane = _windowed(df, keys, F.window(ts, slide), [_KINDS[kind].of_pane(col).alias(name) for name, (kind, col) in aggs.items()], ts, None)
    step = F.expr(f"INTERVAL {slide}")
    starts = F.explode(F.array(*[F.col("window_start") - step * i for i in range(n)]))
    spread = pane.select(starts.alias("window_start"), *keys, *aggs)
    out = spread.groupBy("window_start", *keys).agg(*[_KINDS[kind].merged(F.col(name)).alias(name) for name, (kind, _) in aggs.items()])
    return out.select("window_start", (F.col("window_start") + F.expr(f"INTERVAL {size}")).alias("window_end"), *keys, *aggs)


def latest_per_key(df: DataFrame, keys: Sequence[str], version_cols: Sequence[str]) -> DataFrame:
    """The whole row of the largest version_cols of each key (ties: by the other columns). One partial aggregation, no sort of the log."""
    row = F.struct(*version_cols, *[c for c in df.columns if c not in version_cols])
    return df.groupBy(*keys).agg(F.max(row).alias("_row")).select(*[f"_row.`{c}`" for c in df.columns])


def latest_window(df: DataFrame, end_col: str = "window_end") -> DataFrame:
    """The rows of the newest window."""
    newest = df.agg(F.max(end_col).alias("_newest"))  # one row
    return df.join(F.broadcast(newest), F.col(end_col) == F.col("_newest")).drop("_newest")


def recent(df: DataFrame, ts: str, last: str, as_of: Column | None = None) -> DataFrame:
    """The rows of the last `last` before as_of, by default before the newest time in df; never the wall clock."""
    if as_of is not None:
        return df.where((F.col(ts) > as_of - F.expr(f"INTERVAL {last}")) & (F.col(ts) <= as_of))
    newest = df.agg(F.max(ts).alias("_newest"))  # one row
    return df.join(F.broadcast(newest), F.col(ts) > F.col("_newest") - F.expr(f"INTERVAL {last}")).drop("_newest")


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows in an order, which should be total."""
    return df.orderBy(*order).limit(k)


def ordered_lists(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], lists: Mapping[str, str], sep: str = ",", extra: Sequence[Column] = (), null_text: str | None = None) -> DataFrame:
    """keys and, for each name, its column's values joined by sep; all lists of a group are in the same order. NULL values are left out of their list, or stand in it as null_text, so that lists stay in step."""
    row = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order_cols)], *[F.col(c).cast("string").alias(f"v{i}") for i, c in enumerate(lists.values())])
    out = df.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_rows"), *extra)
    values = lambda field: F.transform("_rows", lambda r: r[field])
    joined = [F.array_join(values(f"v{i}"), sep, null_text).alias(name) for i, name in enumerate(lists)]
    return out.select(*joined, *[c for c in out.columns if c != "_rows"])
