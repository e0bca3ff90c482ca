"""Times the headline queries: prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamctx.operators import joins
from streamctx.plans import adapters as ad
from streamctx.queries import QUERIES

HEADLINE = ("aml_alerts", "asof_enrich", "hop_risk", "security_risk_context", "interval_inner", "band_join", "pattern_alf", "support_context", "latest_row", "shopper_context", "correlate", "star_enrich")


def seconds(make) -> float:
    """The time to compute every row of a query, without keeping them."""
    began = time.perf_counter()
    make().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def busy(spark: SparkSession, d: str) -> DataFrame:
    """events in which one user has a third of all rows."""
    return ad.events(spark, d).withColumn("user_id", F.when(F.col("event_id") % 3 == 0, -1).otherwise(F.col("user_id")))


def asof_four_joins(spark: SparkSession, d: str) -> DataFrame:
    """asof_enrich as four joins one after the other."""
    out = ad.events(spark, d, "purchase").select("user_id", "ts", "event_id")
    for kind in ("signup", "view", "error", "click"):
        out = joins.asof_join(out, ad.events(spark, d, kind).select("user_id", "ts", "event_id"), on=["user_id"], left_ts="ts", right_ts="ts", tiebreak="event_id", prefix=f"{kind}_")
    return out


def control(spark: SparkSession, d: str) -> DataFrame:
    """Work that no change of the library touches: tells machines apart."""
    return spark.range(200_000_000).select(F.xxhash64("id").alias("h")).agg(F.max("h"), F.sum(F.col("h") % 7))


def interval_hot_plain(spark: SparkSession, d: str) -> DataFrame:
    return hot_interval(spark, d, bucketed=False)


def hot_interval(spark: SparkSession, d: str, bucketed: bool = True) -> DataFrame:
    e = busy(spark, d)
    r = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("r_ts"))
    return joins.interval_join(e.where("event_type = 'error'").select("user_id", "ts"), r, on=["user_id"], left_ts="ts", right_ts="r_ts", within="30 minutes", bucketed=bucketed)


def hot_correlate(spark: SparkSession, d: str) -> DataFrame:
    e = busy(spark, d).select(F.col("user_id").cast("string").alias("opcrequestid"), F.col("k").cast("string").alias("besttraceid"), "ts", "event_id")
    return joins.correlate(e.where("event_id % 2 = 0").withColumnRenamed("ts", "audit_ts"), e.where("event_id % 2 = 1"), audit_ts="audit_ts", log_ts="ts", within="1 minute")


def hot_asof_by_itself(spark: SparkSession, d: str) -> DataFrame:
    """hot_asof without a given time slice: keys of over 20,000 rows are found and cut."""
    return hot_asof(spark, d, hot_rows=20_000)


def hot_asof_whole(spark: SparkSession, d: str) -> DataFrame:
    """hot_asof with each key as one sort."""
    return hot_asof(spark, d, hot_rows=0)


def hot_asof(spark: SparkSession, d: str, **how: object) -> DataFrame:
    e = busy(spark, d)
    versions = {kind: (e.where(F.col("event_type") == kind).select("user_id", "ts", "event_id"), "ts") for kind in ("signup", "view", "error", "click")}
    return joins.asof_enrich(e.where("event_type = 'purchase'").select("user_id", "ts", "event_id"), versions, on=["user_id"], ts="ts", tiebreak="event_id", **(how or {"time_slice": "1 day"}))


def main() -> None:
    cpus, d = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    more = {f.__name__: (lambda f=f: f(spark, d)) for f in (hot_interval, hot_correlate, hot_asof)}
    runs = {name: (lambda f=QUERIES[name]: f(spark, d)) for name in HEADLINE} | more
    seconds(runs["aml_alerts"])  # starts the JVM's compilers
    times = {name: round(min(seconds(run) for _ in range(2)), 3) for name, run in runs.items()}
    # beside the total: forms that the library replaces, and the control
    beside = {f.__name__: round(min(seconds(lambda f=f: f(spark, d)) for _ in range(2 if f is not interval_hot_plain else 1)), 3) for f in (control, asof_four_joins, hot_asof_by_itself, hot_asof_whole, interval_hot_plain)}
    print(json.dumps({"metric": "total of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "beside": beside, "sf": d.rstrip("/").rpartition("/sf")[2]}))


if __name__ == "__main__":
    main()
