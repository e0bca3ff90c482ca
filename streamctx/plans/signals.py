"""Vital-sign features, aim patterns, shopper context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import prompt
from ..operators.joins import asof_join
from ..operators.patterns import match_a_lplus_f
from ..operators.windows import tumble_agg


def vital_features(vitals: DataFrame, size: str = "15 minutes", ts: str = "event_time") -> DataFrame:
    """Per patient and tumbling window: means, sample deviation (NULL for one reading), largest temperature."""
    aggs = [F.avg("heart_rate_bpm").alias("avg_hr_15m"), F.stddev_samp("heart_rate_bpm").alias("stddev_hr_15m"), F.avg("respiratory_rate_rpm").alias("avg_rr_15m"), F.max("skin_temp_c").alias("max_temp_c_15m")]
    return tumble_agg(vitals, ["patient_id"], size, aggs, ts=ts)


def sepsis_prompt(features: DataFrame) -> DataFrame:
    c = F.col
    text = prompt("Assess these vitals for sepsis risk; answer with a JSON object of risk_score and justification only. avg_hr_15m=", c("avg_hr_15m"), ", stddev_hr_15m=", c("stddev_hr_15m"), ", avg_rr_15m=", c("avg_rr_15m"), ", max_temp_c_15m=", c("max_temp_c_15m"))
    return features.withColumn("prompt", text)


def suspicious_patterns(actions: DataFrame, history: DataFrame, *, max_reaction: int = 20, max_rate: float = 0.25, tiebreak: str = "seq", ts: str = "event_time", broadcast: bool = False) -> DataFrame:
    """Aim, one or more very fast locks, a headshot by a player who seldom makes one. tiebreak orders actions of one instant."""
    rows = asof_join(actions, history, on=["player_id"], left_ts=ts, right_ts=ts, prefix="h_", broadcast=broadcast)
    kind = F.col("action_type")
    return match_a_lplus_f(
        rows,
        by=["player_id"],
        order=[ts, tiebreak],
        a=kind == "AIM",
        l=(kind == "LOCK_ON_TARGET") & (F.col("reaction_time_ms") < max_reaction),
        f=(kind == "FIRE") & F.col("is_headshot") & (F.col("h_historical_headshot_rate") < max_rate),
        measures={"match_timestamp": F.col(ts), "suspicious_reaction_time": ("last_l", F.col("reaction_time_ms")), "was_headshot": F.col("is_headshot"), "player_historical_hs_rate": ("last_l", F.col("h_historical_headshot_rate")), "player_matches_played": ("last_l", F.col("h_total_matches_played"))},
    )


def shopper_context(pages: DataFrame, carts: DataFrame, chats: DataFrame, *, size: str = "10 minutes", slide: str | None = None, ts: str = "event_time") -> DataFrame:
    """Per user and window: pages in order of time, distinct pages, items added, chat messages (NULL without any). The three feeds are one union, not joins."""
    feed = pages.select("user_id", ts, "page").unionByName(carts.select("user_id", ts, "cart_action"), True).unionByName(chats.select("user_id", ts, "message"), True)
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(ts, c)))), lambda r: r[c]), ",")
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    aggs = [listed("page").alias("page_visited_list"), F.size(F.collect_set("page")).cast("long").alias("distinct_pages_visited_10m"), F.sum(F.when(F.col("cart_action") == "ADD", 1).otherwise(0)).alias("items_added_to_cart_10m"), F.nullif(listed("message"), F.lit("")).alias("chat_message_list")]
    out = feed.groupBy(window.alias("_w"), "user_id").agg(*aggs)
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "user_id", "page_visited_list", "distinct_pages_visited_10m", "items_added_to_cart_10m", "chat_message_list")


def next_best_action(ctx: DataFrame, min_pages: int = 5) -> DataFrame:
    """chat for a user who seems stuck, else discount for one who hesitates at the checkout, else none."""
    stuck: Column = (F.col("distinct_pages_visited_10m") >= min_pages) & (F.col("items_added_to_cart_10m") == 0)
    hesitating = F.col("page_visited_list").endswith("/checkout") & F.col("chat_message_list").isNull()
    return ctx.withColumn("action", F.when(stuck, "chat").when(hesitating, "discount").otherwise("none"))
