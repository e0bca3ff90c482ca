"""Scored high-risk transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import epoch_ms, stable_id
from ..operators.joins import asof_enrich
from ..operators.windows import recent, top_k, tumble_agg
from ..streaming.stateful import asof_enrich_stream

#: Amounts above this count as high.
HIGH_VALUE = 10000


def recent_txn_stats(txns: DataFrame, window: str = "1 hour", ts: str = "event_time", window_col: str | None = None) -> DataFrame:
    """Per customer and tumbling window: transactions, their sum, countries, high amounts; day_bucket_end is the window's end in milliseconds."""
    distinct = F.size(F.collect_set("country_code")).cast("long") if txns.isStreaming else F.countDistinct("country_code")
    stats = tumble_agg(
        txns,
        ["customer_id"],
        window,
        [
            F.count(F.lit(1)).alias("txn_count_1h"),
            F.sum("amount").cast("decimal(18,2)").alias("total_amount_1h"),
            distinct.alias("distinct_countries_1h"),
            F.sum(F.when(F.col("amount") > HIGH_VALUE, 1).otherwise(0)).alias("high_value_count_1h"),
        ],
        ts=ts,
        window_col=window_col,
    )
    return stats.withColumn("day_bucket_end", epoch_ms(F.col("window_end")))


def base_score(status: Column) -> Column:
    part = lambda when, value: F.when(when, F.lit(value)).otherwise(F.lit(0.0))
    score = part(F.col("amount") > HIGH_VALUE, 0.3) + part(F.col("pep_flag"), 0.2) + part(F.col("kyc_risk_level") == "HIGH", 0.2)
    score += F.when(status == "CONFIRMED", 0.3).when(status == "POTENTIAL", 0.15).otherwise(0.0)
    return F.round(score + part(F.col("txn_count_1h") > 2, 0.1), 4)


def enriched(txns: DataFrame, customers: DataFrame, kyc: DataFrame, sanctions: DataFrame, *, window: str = "1 hour", ts: str = "event_time", time_slice: str | None = None, watermark: str = "10 seconds") -> DataFrame:
    """Transactions as of customers, the last closed window's stats, KYC results and sanctions: one shuffle for the four.

    On streams (all four) too: one keyed operator after the windows' aggregate, whose results are a change feed.
    """
    if txns.isStreaming:
        txns, customers, kyc, sanctions = (df.withWatermark(ts, watermark) for df in (txns, customers, kyc, sanctions))
        stats = recent_txn_stats(txns, window, ts, "window").withColumn("window_at", F.window_time("window")).drop("window")
        tables = {"c": (customers, ts), "r": (stats, "window_end", "window_at"), "k": (kyc, ts), "s": (sanctions, ts)}
        out = asof_enrich_stream(txns, tables, on=["customer_id"], ts=ts, watermark=None)
    else:
        stats = recent_txn_stats(txns, window, ts)
        tables = {"c": (customers, ts), "r": (stats, "window_end"), "k": (kyc, ts), "s": (sanctions, ts)}
        out = asof_enrich(txns, tables, on=["customer_id"], ts=ts, time_slice=time_slice)
    own = [c for c in txns.columns if c != ts]
    renamed = {"event_id": "kyc_event_id", "provider": "kyc_provider", "check_type": "kyc_check_type", "status": "status_from_kyc_provider", "risk_level": "kyc_risk_level", "reasons": "reasons_kyc", "completed_at": "kyc_event_completed_at"}
    of_match = {"match_id": "sanction_match_id", "list_type": "sanction_list_type", "entity_id": "sanction_entity_id", "matched_name": "sanction_matched_name", "match_score": "sanction_match_score", "status": "sanction_status", "reviewed_by": "sanction_reviewed_by", "reviewed_at": "sanction_reviewed_at"}
    return out.select(
        *own,
        *[F.col(f"c.{c}") for c in ("full_name", "date_of_birth", "residency_country", "risk_segment", "pep_flag", "kyc_status", "created_at", "updated_at")],
        *[F.col(f"r.{c}") for c in ("day_bucket_end", "txn_count_1h", "total_amount_1h", "distinct_countries_1h", "high_value_count_1h")],
        *[F.col(f"k.{c}").alias(n) for c, n in renamed.items()],
        *[F.col(f"s.{c}").alias(n) for c, n in of_match.items()],
    )


def aml_alerts(txns: DataFrame, customers: DataFrame, kyc: DataFrame, sanctions: DataFrame, *, window: str = "1 hour", status_col: str = "kyc_status", ts: str = "event_time", time_slice: str | None = None, watermark: str = "10 seconds") -> DataFrame:
    """Alerts for transactions that any rule flags. status_col: `sanction_status` tests sanctions, which the rules' values belong to."""
    rows, status = enriched(txns, customers, kyc, sanctions, window=window, ts=ts, time_slice=time_slice, watermark=watermark), F.col(status_col)
    flagged = rows.where((F.col("amount") > HIGH_VALUE) | F.col("pep_flag") | (F.col("kyc_risk_level") == "HIGH") | status.isin("POTENTIAL", "CONFIRMED") | (F.col("txn_count_1h") > 2))
    of_txn = {"amount": "transaction_amount", "currency": "transaction_currency", "direction": "transaction_direction", "counterparty_iban": "transaction_counterparty_iban", "counterparty_name": "transaction_counterparty_name", "merchant_category": "transaction_merchant_category", "country_code": "transaction_country_code", "channel": "transaction_channel"}
    of_customer = {"residency_country": "customer_residency_country", "risk_segment": "customer_risk_segment", "pep_flag": "customer_pep_flag"}
    rest = ["kyc_status", "created_at", "updated_at", "day_bucket_end", "txn_count_1h", "total_amount_1h", "distinct_countries_1h", "high_value_count_1h", "kyc_event_id", "kyc_provider", "kyc_check_type", "status_from_kyc_provider", "kyc_risk_level", "reasons_kyc", "kyc_event_completed_at"]
    rest += [c for c in rows.columns if c.startswith("sanction_")]
    return flagged.select(
        stable_id(F.col("transaction_id")).alias("alert_id"),
        "transaction_id",
        "customer_id",
        F.lit("HIGH_RISK_TXN").alias("alert_type"),
        F.concat(F.lit("High value / high risk transaction from "), "country_code", F.lit(" for customer "), "customer_id").alias("alert_reason"),
        base_score(status).alias("base_score"),
        F.col("tx_timestamp").alias("alert_created_at"),
        *[F.col(c).alias(n) for c, n in {**of_txn, **of_customer}.items()],
        *rest,
    )


def latest_alerts(alerts: DataFrame, k: int = 10) -> DataFrame:
    return top_k(alerts, k, F.desc("alert_created_at"), F.asc("transaction_id"))


def alerts_in_last(alerts: DataFrame, last: str = "1 hour", as_of: Column | None = None) -> DataFrame:
    timed = alerts.withColumn("alert_time", F.timestamp_millis("alert_created_at"))
    return recent(timed, "alert_time", last, as_of)


def alerts_by_country(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("transaction_country_code").agg(F.count(F.lit(1)).alias("alerts"), F.sum("transaction_amount").alias("total_amount"))


def customers_with_potential_sanctions(alerts: DataFrame) -> DataFrame:
    return alerts.where(F.col("sanction_status") == "POTENTIAL").select("customer_id").distinct()
