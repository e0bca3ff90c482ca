"""One wide support row for each ledger update, and activity statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import asof_enrich
from ..operators.windows import tumble_agg


def activity_stats(df: DataFrame, name: str, last_col: str, last_name: str, size: str = "30 minutes", ts: str = "event_time") -> DataFrame:
    """Per customer and tumbling window: events, their sum, and the latest last_col."""
    return tumble_agg(df, ["customer_id"], size, [F.count(F.lit(1)).alias(f"{name}_events_30m"), F.sum("amount").alias(f"{name}_amount_30m"), F.max(last_col).alias(last_name)], ts=ts)


def support_context(ledger: DataFrame, transfers: DataFrame, auths: DataFrame, holds: DataFrame, disputes: DataFrame, notifications: DataFrame, *, mode: str = "latest", ts: str = "event_time", time_slice: str | None = None) -> DataFrame:
    """Each ledger update with the customer's current transfer, authorisation, hold, dispute and notification: one shuffle for all.

    mode: `latest` takes the notification that was current; `all` takes every notification of the customer.
    """
    if mode not in ("latest", "all"):
        raise ValueError(f"mode is latest or all, not {mode}")
    tables = {"t": (transfers, ts), "a": (auths, ts), "h": (holds, ts), "d": (disputes, ts)}
    if mode == "latest":
        tables["n"] = (notifications, ts)
    out = asof_enrich(ledger, tables, on=["customer_id"], ts=ts, time_slice=time_slice)
    if mode == "all":
        every = notifications.select(F.col("customer_id").alias("_c"), F.struct(*notifications.columns).alias("n"))
        out = out.join(every, F.col("customer_id") == F.col("_c"), "left").drop("_c")
    col = lambda t, c, n=None: F.col(f"{t}.`{c}`").alias(n or f"{ {'t': 'transfer', 'a': 'auth', 'h': 'hold', 'd': 'dispute'}[t]}_{c}")
    return out.select(
        *[c for c in ledger.columns if c != ts],
        col("t", "transfer_id", "transfer_id"),
        *[col("t", c) for c in ("type", "amount", "status", "failure_reason", "expected_eta", "tracking_ref", "initiated_at", "updated_at")],
        col("a", "auth_id", "auth_id"),
        *[col("a", c) for c in ("merchant", "amount", "status", "expected_settlement_at", "created_at")],
        col("h", "hold_id", "hold_id"),
        *[col("h", c) for c in ("reason_code", "status", "release_conditions")],
        col("h", "velocity_limit_per_hour", "velocity_limit_per_hour"),
        col("d", "dispute_id", "dispute_id"),
        *[col("d", c) for c in ("stage",)],
        col("d", "provisional_credit_status", "provisional_credit_status"),
        col("d", "next_required_action", "next_required_action"),
        col("d", "updated_at"),
        F.col("n.sent_at"),
        F.col("n.message_type").alias("last_message_type"),
        F.col("n.message").alias("last_message"),
    )


def latest_time_per_customer(df: DataFrame, time_col: str, name: str) -> DataFrame:
    return df.groupBy("customer_id").agg(F.max(time_col).alias(name))
