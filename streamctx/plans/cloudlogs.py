"""Normalised cloud audit and function logs, and questions over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import first_item, iso_timestamp, match_text, split_index
from ..operators.joins import correlate
from ..operators.windows import recent

#: Patterns of resource ids and of lifecycle phases in messages, and event types.
OCID = r"ocid1\.[a-z]+\.[a-z0-9]+\.[a-z]+\.[a-zA-Z0-9]+"
PHASE = r"^(Processing|Initiating|Found|Start request completed[a-z ]*)"
INVOKED, VENDOR = "com.oraclecloud.functions.application.functioninvoke", "com.oraclecloud."


def normalize_audit(raw: DataFrame, split_base: int = 0) -> DataFrame:
    """Flat audit rows with correlation keys. split_base: the number of the first part of an id (see split_index)."""
    c = F.col
    opc = first_item(c("data.request.headers.`opc-request-id`"))
    part = lambda col, i: split_index(c(col), "/", i, split_base)
    return raw.where(c("type").startswith(VENDOR)).select(
        iso_timestamp(c("time")).alias("audittime"),
        c("type").alias("audittype"),
        c("source").alias("auditsource"),
        c("oracle.compartmentid").alias("compartmentid"),
        c("oracle.loggroupid").alias("loggroupid"),
        c("data.eventName").alias("eventname"),
        c("data.eventGroupingId").alias("eventgroupingid"),
        c("data.resourceId").alias("resourceid"),
        c("data.message").alias("auditmessage"),
        c("data.request.path").alias("requestpath"),
        c("data.request.action").alias("requestaction"),
        c("data.request.id").alias("auditrequestid"),
        c("data.response.status").cast("string").alias("responsestatus"),
        c("data.response.responseTime").alias("responsetime"),
        c("data.identity.principalName").alias("principalname"),
        c("data.identity.principalId").alias("principalid"),
        opc.alias("opcrequestid"),
        part("data.request.id", 1).alias("traceid"),
        part("data.request.id", 2).alias("spanid"),
        part("data.eventGroupingId", 1).alias("eventtraceid"),
        part("data.eventGroupingId", 2).alias("eventspanid"),
        F.coalesce(opc, part("data.request.id", 1), part("data.eventGroupingId", 1)).alias("best_request_correlation"),
        F.coalesce(part("data.request.id", 1), part("data.eventGroupingId", 1)).alias("besttraceid"),
    )


def normalize_function_logs(raw: DataFrame, split_base: int = 0) -> DataFrame:
    """Flat rows of function invocations that logged a message."""
    c = F.col
    full = F.coalesce(c("data.opcRequestId"), c("data.requestId"))
    return raw.where((c("type") == INVOKED) & c("data.message").isNotNull()).select(
        iso_timestamp(c("time")).alias("logtime"),
        c("type").alias("logtype"),
        c("source").alias("logsource"),
        c("subject").alias("logsubject"),
        c("oracle.compartmentid").alias("compartmentid"),
        c("oracle.loggroupid").alias("loggroupid"),
        c("oracle.logid").alias("logid"),
        c("data.applicationId").alias("applicationid"),
        c("data.functionId").alias("functionid"),
        c("data.containerId").alias("containerid"),
        c("data.opcRequestId").alias("opcrequestid"),
        c("data.requestId").alias("requestid"),
        full.alias("correlationid_full"),
        split_index(full, "/", 1, split_base).alias("besttraceid"),
        c("data.src").alias("src"),
        c("data.message").alias("message"),
        match_text(c("data.message"), OCID).alias("containerinstance_ocid"),
        match_text(c("data.message"), PHASE).alias("lifecycle_phase"),
    )


def failed_requests(audit: DataFrame, last: str = "15 minutes", as_of: Column | None = None) -> DataFrame:
    return recent(audit, "audittime", last, as_of).where(F.col("responsestatus").startswith("4") | F.col("responsestatus").startswith("5"))


def write_actions(audit: DataFrame, last: str = "15 minutes", as_of: Column | None = None) -> DataFrame:
    return recent(audit, "audittime", last, as_of).where(F.col("requestaction").isin("POST", "PUT", "DELETE"))


def error_logs(logs: DataFrame, last: str = "15 minutes", as_of: Column | None = None) -> DataFrame:
    m = F.col("message")
    return recent(logs, "logtime", last, as_of).where(m.contains("error") | m.contains("failed") | m.contains("exception"))


def trace_errors_to_actions(logs: DataFrame, audit: DataFrame, within: str = "15 minutes") -> DataFrame:
    """Error messages with the write actions that share their request id, or else their trace id."""
    m = F.col("message")
    errors = logs.where(m.contains("error") | m.contains("failed") | m.contains("exception"))
    return correlate(audit.where(F.col("requestaction").isin("POST", "PUT", "DELETE")), errors, audit_ts="audittime", log_ts="logtime", within=within)
