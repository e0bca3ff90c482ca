"""Viewers who look at titles without playing any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import epoch_ms, epoch_us, prompt
from ..operators.joins import _micros, asof_join
from ..operators.windows import hop_agg, ordered_lists, tumble_agg
from ..streaming.stateful import asof_stream


def weighted_interactions(interactions: DataFrame, content: DataFrame, *, include_play: bool = False, ts: str = "event_time", broadcast: bool = False, time_slice: str | None = None, watermark: str = "10 seconds") -> DataFrame:
    """Interest events with the metadata that was current, and a score. include_play keeps plays too, which the plain filter leaves out. On streams too."""
    types = ["view_details", "hover", *(["play"] if include_play else [])]
    how = {"on": ["content_id"], "left_ts": ts, "right_ts": ts, "how": "inner", "prefix": "cm_"}
    wanted = interactions.where(F.col("event_type").isin(types))
    joined = asof_stream(wanted, content, **how, watermark=watermark) if wanted.isStreaming else asof_join(wanted, content, **how, broadcast=broadcast, time_slice=time_slice)
    score = F.when(F.col("event_type") == "view_details", 3).when(F.col("event_type") == "hover", 1).otherwise(0)
    return joined.withColumnRenamed("cm_title", "title").withColumnRenamed("cm_genres", "genres").withColumn("weighted_interest_score", score)


def _parts() -> dict[str, tuple[str, Column]]:
    is_ = lambda kind: F.when(F.col("event_type") == kind, 1).otherwise(0)
    return {"weighted_interest_score_sum": ("sum", F.col("weighted_interest_score")), "abandoned_views": ("sum", is_("view_details")), "plays": ("sum", is_("play"))}


def viewer_interest(interactions: DataFrame, content: DataFrame, *, include_play: bool = False, ts: str = "event_time", size: str = "5 minutes", slide: str = "1 minute", panes: bool = False, time_slice: str | None = None, watermark: str = "10 seconds", window_col: str | None = None) -> DataFrame:
    """Per user, genres and hopping window: interest, abandoned views, whether something was played. window_col: `window` for indecisive_viewers on a stream."""
    rows = weighted_interactions(interactions, content, include_play=include_play, ts=ts, time_slice=time_slice, watermark=watermark)
    out = hop_agg(rows, ["user_id", "genres"], size, slide, _parts(), ts=ts, panes=panes, window_col=window_col)
    return out.withColumn("has_played_content", F.col("plays") > 0).drop("plays")


def indecisive_viewers(interest: DataFrame, min_abandoned: int = 2) -> DataFrame:
    """Per user and window start: genres and their scores in one order, the views, and a prompt, where more than min_abandoned views led to no play."""
    if interest.isStreaming:
        keys, shown = ["window", "user_id"], {"window_start": F.col("window.start"), "window_end": F.col("window.end")}
    else:
        keys, shown = ["window_start", "window_end", "user_id"], {}
    extra = [F.count(F.lit(1)).alias("cnt"), F.sum("abandoned_views").alias("abandoned_views_in_window"), F.sum(F.when(F.col("has_played_content"), 1).otherwise(0)).alias("has_played_content_count")]
    lists = ordered_lists(interest, keys, ["genres"], {"genres_list": "genres", "weighted_interest_score_sum_list": "weighted_interest_score_sum"}, extra=extra)
    hit = lists.withColumns(shown) if shown else lists
    return _prompted(hit.where((F.col("abandoned_views_in_window") > min_abandoned) & (F.col("has_played_content_count") == 0)))


def _prompted(hit: DataFrame) -> DataFrame:
    text = prompt("User ", F.col("user_id"), " seems indecisive: after viewing ", F.col("abandoned_views_in_window"), " titles in a few minutes, nothing was played. Suggest one title in two friendly sentences. Genres: [", F.col("genres_list"), "]; interest, in the same order: [", F.col("weighted_interest_score_sum_list"), "]")
    return hit.withColumn("w_start_ux", epoch_ms(F.col("window_start"))).withColumn("llm_prompt", text)


def indecisive_viewers_stream(interactions: DataFrame, content: DataFrame, min_abandoned: int = 2, *, include_play: bool = False, ts: str = "event_time", size: str = "5 minutes", slide: str = "1 minute", watermark: str = "10 seconds") -> DataFrame:
    """indecisive_viewers of viewer_interest on streams, whose state isn't a row for each window: it is a sum for each user, genres and pane of `slide`, and two lists of these for each user and length of a window.

    A list holds the panes of two lengths from a multiple of `size` on, so each window that begins in the first of them lies in it whole; its windows come out when it ends, up to `size` after their own end. size must be a multiple of slide.
    """
    long, step = _micros(size), _micros(slide)
    if long % step:
        raise ValueError(f"{size} is not a multiple of {slide}")
    rows = weighted_interactions(interactions, content, include_play=include_play, ts=ts, watermark=watermark)
    sums = list(_parts())
    panes = tumble_agg(rows, ["user_id", "genres"], slide, [F.sum(c).alias(name) for name, (_, c) in _parts().items()], ts=ts, window_col="pane")
    panes = panes.select("user_id", "genres", *sums, epoch_us(F.col("window_start")).alias("at"), F.window_time("pane").alias("time"))
    span = F.window("time", f"{2 * long} microseconds", f"{long} microseconds").alias("span")
    lists = panes.groupBy(span, "user_id").agg(F.collect_list(F.struct("at", "genres", *sums)).alias("panes"))
    total = lambda rows, name: F.aggregate(rows, F.lit(0).cast("long"), lambda n, p: n + F.coalesce(p[name], F.lit(0)))
    begin = lambda i: epoch_us(F.col("span.start")) + i * F.lit(step)
    own = lambda i: F.filter("panes", lambda p: (p["at"] >= begin(i)) & (p["at"] < begin(i) + long))
    every = F.sequence(F.lit(0), F.lit(long // step - 1))
    some = F.filter(every, lambda i: (F.size(own(i)) > 0) & (total(own(i), "abandoned_views") > min_abandoned) & (total(own(i), "plays") == 0))
    found = lists.where(total(F.col("panes"), "abandoned_views") > min_abandoned).select("span", "user_id", "panes", F.explode(some).alias("i")).select("span", "user_id", "i", own(F.col("i")).alias("panes"))
    of = lambda g: F.filter("panes", lambda p: p["genres"].eqNullSafe(g))
    kinds = F.array_distinct(F.transform("panes", lambda p: p["genres"]))
    lines = F.array_sort(F.transform(kinds, lambda g: F.struct(g.alias("genres"), total(of(g), "weighted_interest_score_sum").alias("score"))))
    found = found.select("span", "user_id", "i", "panes", lines.alias("lines"))
    start = F.col("span.start") + F.expr(f"INTERVAL {slide}") * F.col("i")
    joined = lambda name: F.array_join(F.transform("lines", lambda x: x[name].cast("string")), ",")
    hit = found.select(joined("genres").alias("genres_list"), joined("score").alias("weighted_interest_score_sum_list"), "user_id", F.size("lines").cast("long").alias("cnt"), total(F.col("panes"), "abandoned_views").alias("abandoned_views_in_window"), F.lit(0).cast("long").alias("has_played_content_count"), start.alias("window_start"), (start + F.expr(f"INTERVAL {size}")).alias("window_end"))
    return _prompted(hit)
