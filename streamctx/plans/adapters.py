"""The given tables relabelled as the jobs' feeds. `ts` stays a timestamp without zone and is the event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import epoch_ms, json_value


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, *types: str) -> DataFrame:
    """events with k (the number in props), of the given types."""
    df = table(spark, sf_dir, "events").withColumn("k", json_value(F.col("props"), "$.k").cast("bigint"))
    return df.where(F.col("event_type").isin(list(types))) if types else df


def s(col: str) -> Column:
    return F.col(col).cast("string")


def feed(df: DataFrame, **cols: Column) -> DataFrame:
    """event_time and the given columns."""
    return df.select(F.col("ts").alias("event_time"), *[c.alias(n) for n, c in cols.items()])


def transactions(df: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return feed(df, transaction_id=s("event_id"), account_id=none, customer_id=s("user_id"), amount=(F.col("value") * 100).cast("decimal(18,2)"), currency=F.lit("EUR"), direction=F.lit("DEBIT"), counterparty_iban=none, counterparty_name=none, merchant_category=none, country_code=F.concat(F.lit("C"), F.col("k") % 10), channel=F.lit("WEB"), tx_timestamp=epoch_ms(F.col("ts")))


def customers(df: DataFrame) -> DataFrame:
    k, none = F.col("k"), F.lit(None).cast("string")
    return feed(df, customer_id=s("user_id"), full_name=none, date_of_birth=F.lit(None).cast("date"), residency_country=none, risk_segment=none, pep_flag=k % 10 == 0, kyc_status=F.when(k % 5 == 0, "FAILED").when(k % 5 == 1, "PENDING").otherwise("PASSED"), created_at=epoch_ms(F.col("ts")), updated_at=epoch_ms(F.col("ts")))


def kyc_results(df: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return feed(df, event_id=s("event_id"), customer_id=s("user_id"), provider=none, check_type=none, status=none, risk_level=F.when(F.col("k") % 10 == 1, "HIGH").otherwise("LOW"), reasons=F.col("props"), completed_at=epoch_ms(F.col("ts")))


def sanctions(df: DataFrame) -> DataFrame:
    k, none = F.col("k"), F.lit(None).cast("string")
    return feed(df, match_id=s("event_id"), customer_id=s("user_id"), list_type=none, entity_id=none, matched_name=none, match_score=F.col("value"), status=F.when(k % 3 == 0, "POTENTIAL").when(k % 3 == 1, "CONFIRMED").otherwise("DISMISSED"), reviewed_by=none, reviewed_at=epoch_ms(F.col("ts")))


def audit_raw(df: DataFrame) -> DataFrame:
    """Nested audit rows, with ids of one to three parts and missing headers."""
    id_ = F.concat_ws("/", s("event_id"), F.when(F.col("k") % 3 != 0, s("k")), F.when(F.col("k") % 3 == 2, s("user_id")))
    headers = F.when(F.col("k") % 2 == 0, F.array(F.concat(F.lit("opc"), F.col("user_id"))))
    return df.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("time"),
        F.concat(F.lit("com.oraclecloud."), "event_type").alias("type"),
        F.lit("src").alias("source"),
        F.struct(F.lit("comp").alias("compartmentid"), F.lit("group").alias("loggroupid")).alias("oracle"),
        F.struct(
            F.col("event_type").alias("eventName"),
            F.concat(F.lit("g/"), s("k")).alias("eventGroupingId"),
            s("event_id").alias("resourceId"),
            F.col("props").alias("message"),
            F.struct(F.when(F.col("k") % 4 == 0, "GET").when(F.col("k") % 4 == 1, "POST").when(F.col("k") % 4 == 2, "PUT").otherwise("DELETE").alias("action"), F.struct(headers.alias("opc-request-id")).alias("headers"), id_.alias("id"), F.lit("/x").alias("path")).alias("request"),
            F.struct((200 + (F.col("k") % 4) * 100).cast("string").alias("status"), F.lit("t").alias("responseTime")).alias("response"),
            F.struct(s("user_id").alias("principalName"), s("user_id").alias("principalId")).alias("identity"),
        ).alias("data"),
    )


def function_log_raw(df: DataFrame) -> DataFrame:
    opc = F.when(F.col("k") % 2 == 0, F.concat(F.lit("opc"), F.col("user_id")))
    message = F.when(F.col("k") % 3 == 0, F.concat(F.lit("Processing failed for ocid1.fn.oc1.iad.a"), F.col("event_id"))).when(F.col("k") % 3 == 1, F.lit("error: timeout")).when(F.col("k") < 90, F.lit("plain"))
    return df.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("time"),
        F.lit("com.oraclecloud.functions.application.functioninvoke").alias("type"),
        F.lit("fn").alias("source"),
        F.col("event_type").alias("subject"),
        F.struct(F.lit("comp").alias("compartmentid"), F.lit("group").alias("loggroupid"), F.lit("log").alias("logid")).alias("oracle"),
        F.struct(s("user_id").alias("applicationId"), s("event_id").alias("functionId"), F.lit("c").alias("containerId"), message.alias("message"), opc.alias("opcRequestId"), F.concat(s("event_id"), F.lit("/"), s("k")).alias("requestId"), F.lit("s").alias("src")).alias("data"),
    )
