"""The library's queries over the given tables, and the same in DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.model import enrich_with_model, parse_model_reply
from .functions.scalars import epoch_ms, json_value, match_text, split_index
from .operators import joins, patterns, windows
from .plans import adapters as ad
from .plans import aml, bank, cloudlogs, incidents, signals, soc, viewer
from .sources import io, schemas
from .streaming import stateful
from .streaming.replay import replay, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: events with the number in props.
E = "e AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, epoch_us(ts) // 1000 AS ms FROM events)"


def query(sql: str | None = None) -> Callable:
    """Registers a query, with DuckDB SQL in which {E} is the table e."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.replace("{E}", E)
        return f

    return add


def ms(col: str, name: str | None = None):
    return epoch_ms(F.col(col)).alias(name or col)


def bounds_in_ms(df: DataFrame) -> DataFrame:
    """df with window bounds in epoch milliseconds: the same in every session zone."""
    return df.select(ms("window_start"), ms("window_end"), *[c for c in df.columns if c not in ("window_start", "window_end")])


@query("""WITH {E} SELECT epoch_ms(date_trunc('hour', ts)) AS window_start, epoch_ms(date_trunc('hour', ts)) + 3600000 AS window_end, user_id, count(*) AS n, round(sum(value), 4) AS total,
    count(DISTINCT event_type) AS kinds, sum(CASE WHEN value > 100 THEN 1 ELSE 0 END)::BIGINT AS high, max(ms) AS last_at FROM e GROUP BY date_trunc('hour', ts), user_id""")
def tumble_stats(spark, d):
    aggs = [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.countDistinct("event_type").alias("kinds"), F.sum(F.when(F.col("value") > 100, 1).otherwise(0)).alias("high"), F.max(epoch_ms(F.col("ts"))).alias("last_at")]
    return bounds_in_ms(windows.tumble_agg(ad.events(spark, d), ["user_id"], "1 hour", aggs, ts="ts"))


HOP = """h AS (SELECT date_trunc('hour', ts) - to_hours(i) AS ws, user_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS errors, count(*) AS n, max(value) AS most,
    10 * sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT + CASE WHEN max(value) > 100 THEN 20 ELSE 0 END AS risk FROM e, (SELECT unnest(range(6))::BIGINT AS i) GROUP BY ws, user_id)"""


def _hop(spark, d, panes=True):
    parts = {"errors": ("sum", F.when(F.col("event_type") == "error", 1).otherwise(0)), "n": ("count", F.lit(1)), "most": ("max", F.col("value"))}
    out = windows.hop_agg(ad.events(spark, d), ["user_id"], "6 hours", "1 hour", parts, ts="ts", panes=panes)
    return out.withColumn("risk", 10 * F.col("errors") + F.when(F.col("most") > 100, 20).otherwise(0))


@query(f"WITH {{E}}, {HOP} SELECT epoch_ms(ws) AS window_start, epoch_ms(ws) + 21600000 AS window_end, user_id, errors, n, most, risk FROM h")
def hop_risk(spark, d):
    return bounds_in_ms(_hop(spark, d))


@query(f"WITH {{E}}, {HOP} SELECT user_id, risk, epoch_ms(ws) AS window_start FROM h ORDER BY risk DESC, user_id, ws LIMIT 5")
def top_risk(spark, d):
    return windows.top_k(_hop(spark, d).select("user_id", "risk", ms("window_start")), 5, F.desc("risk"), F.asc("user_id"), F.asc("window_start"))


@query(f"WITH {{E}}, {HOP} SELECT user_id, risk FROM h WHERE ws = (SELECT max(ws) FROM h)")
def risk_right_now(spark, d):
    return windows.latest_window(_hop(spark, d)).select("user_id", "risk")


@query(f"WITH {{E}}, {HOP} SELECT user_id, epoch_ms(ws) AS window_start, risk, risk - lag(risk) OVER w AS risk_change, errors - lag(errors) OVER w AS errors_change FROM h WINDOW w AS (PARTITION BY user_id ORDER BY ws)")
def explain_risk(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("window_start")
    return _hop(spark, d).select("user_id", ms("window_start"), "risk", (F.col("risk") - F.lag("risk").over(w)).alias("risk_change"), (F.col("errors") - F.lag("errors").over(w)).alias("errors_change"))


ASOF = """WITH {E}, p AS (SELECT * FROM e WHERE event_type = 'purchase'), s AS (SELECT * FROM e WHERE event_type = 'signup')
    SELECT p.event_id, p.user_id, p.value, s.event_id AS v_event_id, s.value AS v_value, s.ms AS v_ms FROM p ASOF %s JOIN s ON p.user_id = s.user_id AND p.ts >= s.ts"""


def _asof(spark, d, how, broadcast=False):
    versions = ad.events(spark, d, "signup").select("user_id", "ts", "event_id", "value")
    out = joins.asof_join(ad.events(spark, d, "purchase"), versions, on=["user_id"], left_ts="ts", right_ts="ts", how=how, tiebreak="event_id", prefix="v_", broadcast=broadcast)
    return out.select("event_id", "user_id", "value", "v_event_id", "v_value", ms("v_ts", "v_ms"))


@query(ASOF % "LEFT")
def asof_left(spark, d):
    return _asof(spark, d, "left")


@query(ASOF % "")
def asof_inner(spark, d):
    return _asof(spark, d, "inner")


@query("""WITH {E}, p AS (SELECT * FROM e WHERE event_type = 'purchase') SELECT p.event_id, s.event_id AS signup_id, v.event_id AS view_id, r.event_id AS error_id, c.event_id AS click_id FROM p
    ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'signup') s ON p.user_id = s.user_id AND p.ts >= s.ts
    ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts
    ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'error') r ON p.user_id = r.user_id AND p.ts >= r.ts
    ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts""")
def asof_enrich(spark, d):
    return _asof_enrich(spark, d)


def _asof_enrich(spark, d, **how):
    kinds = ("signup", "view", "error", "click")
    tables = {k: (ad.events(spark, d, k).select("user_id", "ts", "event_id"), "ts") for k in kinds}
    out = joins.asof_enrich(ad.events(spark, d, "purchase").select("user_id", "ts", "event_id"), tables, on=["user_id"], ts="ts", tiebreak="event_id", **how)
    return out.select("event_id", *[F.col(f"{k}.event_id").alias(f"{k}_id") for k in kinds])


@query(ORACLE_SQL["asof_enrich"])
def asof_sliced(spark, d):
    return _asof_enrich(spark, d, time_slice="7 days")


@query(ORACLE_SQL["asof_enrich"])
def asof_hot_keys(spark, d):
    """Keys of over 40 rows are hot and cut at quantiles of their times; the others stay whole."""
    return _asof_enrich(spark, d, hot_rows=40)


@query("""WITH {E}, p AS (SELECT * FROM e WHERE event_type = 'purchase'), s AS (SELECT user_id, date_trunc('day', ts) + INTERVAL 1 DAY AS w, count(*) AS n FROM e GROUP BY ALL)
    SELECT p.event_id, s.n, epoch_ms(s.w) AS w FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.ts >= s.w""")
def asof_window_feature(spark, d):
    stats = windows.tumble_agg(ad.events(spark, d), ["user_id"], "1 day", [F.count(F.lit(1)).alias("n")], ts="ts")
    out = joins.asof_join(ad.events(spark, d, "purchase").select("user_id", "ts", "event_id"), stats.select("user_id", "window_end", "n"), on=["user_id"], left_ts="ts", right_ts="window_end")
    return out.select("event_id", "n", ms("window_end", "w"))


AML = """WITH {E}, t AS (SELECT *, CAST(value * 100 AS DECIMAL(18, 2)) AS amount, 'C' || (k % 10) AS country FROM e WHERE event_type = 'purchase'),
    c AS (SELECT user_id, ts, k % 10 = 0 AS pep, CASE WHEN k % 5 = 0 THEN 'FAILED' WHEN k % 5 = 1 THEN 'PENDING' ELSE 'PASSED' END AS kyc FROM e WHERE event_type = 'signup'),
    r AS (SELECT user_id, date_trunc('day', ts) + INTERVAL 1 DAY AS w, count(*) AS n, sum(amount) AS total, count(DISTINCT country) AS countries, count(*) FILTER (amount > 10000) AS high FROM t GROUP BY ALL),
    q AS (SELECT user_id, ts, CASE WHEN k % 10 = 1 THEN 'HIGH' ELSE 'LOW' END AS risk FROM e WHERE event_type = 'view'),
    x AS (SELECT user_id, ts, CASE WHEN k % 3 = 0 THEN 'POTENTIAL' WHEN k % 3 = 1 THEN 'CONFIRMED' ELSE 'DISMISSED' END AS st FROM e WHERE event_type = 'error'),
    j AS (SELECT t.event_id, t.user_id, t.amount, t.country, t.ms, c.pep, c.kyc, r.n, r.total, r.countries, r.high, q.risk, x.st, %s AS status FROM t
        ASOF LEFT JOIN c ON t.user_id = c.user_id AND t.ts >= c.ts ASOF LEFT JOIN r ON t.user_id = r.user_id AND t.ts >= r.w
        ASOF LEFT JOIN q ON t.user_id = q.user_id AND t.ts >= q.ts ASOF LEFT JOIN x ON t.user_id = x.user_id AND t.ts >= x.ts),
    alerts AS (SELECT md5(event_id::VARCHAR) AS alert_id, event_id::VARCHAR AS transaction_id, user_id::VARCHAR AS customer_id, 'High value / high risk transaction from ' || country || ' for customer ' || user_id AS alert_reason,
        round((CASE WHEN amount > 10000 THEN 0.3::DOUBLE ELSE 0 END) + (CASE WHEN pep THEN 0.2::DOUBLE ELSE 0 END) + (CASE WHEN risk = 'HIGH' THEN 0.2::DOUBLE ELSE 0 END)
            + (CASE status WHEN 'CONFIRMED' THEN 0.3::DOUBLE WHEN 'POTENTIAL' THEN 0.15::DOUBLE ELSE 0 END) + (CASE WHEN n > 2 THEN 0.1::DOUBLE ELSE 0 END), 4) AS base_score,
        amount::DOUBLE AS transaction_amount, country AS transaction_country_code, pep AS customer_pep_flag, kyc AS kyc_status, n AS txn_count_1h, total::DOUBLE AS total_amount_1h, countries AS distinct_countries_1h, high AS high_value_count_1h,
        risk AS kyc_risk_level, st AS sanction_status, ms AS alert_created_at
        FROM j WHERE amount > 10000 OR pep OR risk = 'HIGH' OR status IN ('POTENTIAL', 'CONFIRMED') OR n > 2) """


def _alerts(spark, d, **how):
    return aml.aml_alerts(ad.transactions(ad.events(spark, d, "purchase")), ad.customers(ad.events(spark, d, "signup")), ad.kyc_results(ad.events(spark, d, "view")), ad.sanctions(ad.events(spark, d, "error")), window="1 day", **how)


def _shown(alerts):
    return alerts.select("alert_id", "transaction_id", "customer_id", "alert_reason", "base_score", F.col("transaction_amount").cast("double").alias("transaction_amount"), "transaction_country_code", "customer_pep_flag", "kyc_status", "txn_count_1h", F.col("total_amount_1h").cast("double").alias("total_amount_1h"), "distinct_countries_1h", "high_value_count_1h", "kyc_risk_level", "sanction_status", "alert_created_at")


@query(AML.replace("%s", "c.kyc") + "SELECT * FROM alerts")
def aml_alerts(spark, d):
    return _shown(_alerts(spark, d))


@query(AML.replace("%s", "x.st") + "SELECT * FROM alerts")
def aml_alerts_by_sanction(spark, d):
    return _shown(_alerts(spark, d, status_col="sanction_status"))


@query(AML.replace("%s", "c.kyc") + "SELECT transaction_country_code, count(*) AS alerts, sum(transaction_amount::DECIMAL(18, 2))::DOUBLE AS total_amount FROM alerts GROUP BY ALL")
def aml_by_country(spark, d):
    return aml.alerts_by_country(_alerts(spark, d)).withColumn("total_amount", F.col("total_amount").cast("double"))


@query(AML.replace("%s", "c.kyc") + "SELECT transaction_id, base_score FROM alerts ORDER BY alert_created_at DESC, transaction_id LIMIT 10")
def aml_latest(spark, d):
    return aml.latest_alerts(_alerts(spark, d)).select("transaction_id", "base_score")


@query(AML.replace("%s", "c.kyc") + "SELECT transaction_id FROM alerts WHERE alert_created_at > (SELECT max(alert_created_at) FROM alerts) - 86400000")
def aml_last_day(spark, d):
    return aml.alerts_in_last(_alerts(spark, d), "1 day").select("transaction_id")


@query(AML.replace("%s", "c.kyc") + "SELECT DISTINCT customer_id FROM alerts WHERE sanction_status = 'POTENTIAL'")
def aml_potential_sanctions(spark, d):
    return aml.customers_with_potential_sanctions(_alerts(spark, d))


def _pair(spark, d, left, right, **how):
    r = ad.events(spark, d, right).select("user_id", F.col("ts").alias("r_ts"), F.col("event_id").alias("r_event_id"))
    return joins.interval_join(ad.events(spark, d, left).select("user_id", "ts", "event_id"), r, on=["user_id"], left_ts="ts", right_ts="r_ts", **how).select("user_id", "event_id", "r_event_id")


INTERVAL = """WITH {E} SELECT l.user_id, l.event_id, r.event_id AS r_event_id FROM (SELECT * FROM e WHERE event_type = 'error') l %s JOIN (SELECT * FROM e WHERE event_type = 'click') r
    ON l.user_id = r.user_id AND r.ts BETWEEN l.ts - INTERVAL 6 HOUR AND l.ts + INTERVAL 6 HOUR"""


@query(INTERVAL % "")
def interval_inner(spark, d):
    return _pair(spark, d, "error", "click", within="6 hours", bucketed=True)


@query(INTERVAL % "LEFT")
def interval_left(spark, d):
    return _pair(spark, d, "error", "click", within="6 hours", how="left")


@query("""WITH {E} SELECT a.event_id AS error_id, b.event_id AS click_id, c.event_id AS view_id FROM (SELECT * FROM e WHERE event_type = 'error' AND k < 50) a
    JOIN (SELECT * FROM e WHERE event_type = 'click') b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 12 HOUR AND a.ts + INTERVAL 12 HOUR
    JOIN (SELECT * FROM e WHERE event_type = 'view') c ON a.user_id = c.user_id AND b.k % 4 = c.k % 4 AND c.ts BETWEEN a.ts - INTERVAL 12 HOUR AND a.ts + INTERVAL 12 HOUR""")
def kill_chain(spark, d):
    """K-9 over events: error = sign-in, click = download, view = detection; file = k mod 4."""
    t, file = "event_time", F.concat(F.lit("f"), F.col("k") % 4)
    logins = ad.feed(ad.events(spark, d, "error"), user_email=ad.s("user_id"), ip_address=ad.s("event_id"), country=F.lit("c"), is_suspicious=F.col("k") < 50)
    got = ad.feed(ad.events(spark, d, "click"), user=ad.s("user_id"), url=ad.s("event_id"), file_name=file)
    found = ad.feed(ad.events(spark, d, "view"), user_email=ad.s("user_id"), file_name=file, detection_name=ad.s("event_id"), severity=F.lit("CRITICAL"), action_taken=F.lit("x"))
    out = incidents.correlated_incidents(logins, got, found, within="12 hours", ts=t, bucketed=True)
    return out.select(F.col("ip_address").cast("bigint").alias("error_id"), F.col("downloaded_url").cast("bigint").alias("click_id"), F.col("malware_name").cast("bigint").alias("view_id"))


@query("""WITH {E}, x AS (SELECT *, CASE WHEN k < 50 THEN 'pool' ELSE 'u' || user_id % 20 END AS f, CASE WHEN k < 50 THEN 'u' || user_id % 20 ELSE 'pool' END AS g FROM e)
    SELECT l.g AS attacker, l.event_id AS block_number, l.value AS tx_amount, l.ms AS attack_ms FROM x l JOIN x r ON l.f = 'pool' AND r.g = 'pool' AND l.g = r.f AND l.value > 10 AND r.value > 10
    AND r.event_id BETWEEN l.event_id AND l.event_id + 20 AND r.ts BETWEEN l.ts - INTERVAL 24 HOUR AND l.ts + INTERVAL 24 HOUR""")
def interval_self(spark, d):
    return _attacks(spark, d).select("attacker", "block_number", "tx_amount", ms("attack_timestamp", "attack_ms"))


def _attacks(spark, d):
    out = F.col("k") < 50
    who = F.concat(F.lit("u"), F.col("user_id") % 20)
    txs = ad.feed(ad.events(spark, d), from_address=F.when(out, "pool").otherwise(who), to_address=F.when(out, who).otherwise("pool"), tx_token=F.lit("T"), tx_amount=F.col("value"), block_number=F.col("event_id"))
    return incidents.flash_loan_attacks(txs, "pool", 10, 20, "24 hours")


@query("""WITH {E}, x AS (SELECT *, CASE WHEN k < 50 THEN 'pool' ELSE 'u' || user_id % 20 END AS f, CASE WHEN k < 50 THEN 'u' || user_id % 20 ELSE 'pool' END AS g FROM e),
    a AS (SELECT l.g AS attacker, l.event_id AS block_number, l.ts FROM x l JOIN x r ON l.f = 'pool' AND r.g = 'pool' AND l.g = r.f AND l.value > 10 AND r.value > 10
        AND r.event_id BETWEEN l.event_id AND l.event_id + 20 AND r.ts BETWEEN l.ts - INTERVAL 24 HOUR AND l.ts + INTERVAL 24 HOUR)
    SELECT a.attacker, a.block_number, p.value AS price_at_attack, m.k AS gas_at_attack FROM a LEFT JOIN (SELECT * FROM e WHERE event_type = 'view' AND k % 2 = 0) p ON p.ts BETWEEN a.ts - INTERVAL 5 MINUTE AND a.ts + INTERVAL 5 MINUTE
    LEFT JOIN e m ON m.event_id = a.block_number AND m.event_type = 'click'""")
def sentinel_triggers(spark, d):
    prices = ad.feed(ad.events(spark, d, "view"), price=F.col("value"), join_helper=F.when(F.col("k") % 2 == 0, "A"))
    gas = ad.feed(ad.events(spark, d, "click"), block_number=F.col("event_id"), avg_gas_price_gwei=F.col("k"))
    return incidents.sentinel_triggers(_attacks(spark, d), prices, gas, price_within="5 minutes").select("attacker", "block_number", "price_at_attack", "gas_at_attack")


@query("""WITH {E} SELECT l.event_id, r.event_id AS r_event_id FROM (SELECT * FROM e WHERE event_type = 'purchase' AND value > 100) l LEFT JOIN (SELECT * FROM e WHERE event_type = 'signup') r
    ON r.ts BETWEEN l.ts - INTERVAL 10 MINUTE AND l.ts + INTERVAL 10 MINUTE""")
def band_join(spark, d):
    r = ad.events(spark, d, "signup").select(F.col("ts").alias("r_ts"), F.col("event_id").alias("r_event_id"))
    left = ad.events(spark, d, "purchase").where("value > 100").select("ts", "event_id")
    return joins.band_join(left, r, left_ts="ts", right_ts="r_ts", within="10 minutes").select("event_id", "r_event_id")


@query("""WITH {E} SELECT user_id, epoch_ms(date_trunc('day', ts)) AS day, string_agg(event_type, ',' ORDER BY ts, event_id) AS kinds, string_agg(CASE WHEN k % 3 = 0 THEN '-' ELSE k::VARCHAR END, ',' ORDER BY ts, event_id) AS ks,
    coalesce(string_agg(CASE WHEN k % 3 <> 0 THEN k::VARCHAR END, ',' ORDER BY ts, event_id), '') AS known FROM e GROUP BY user_id, date_trunc('day', ts)""")
def ordered_lists_with_nulls(spark, d):
    e = ad.events(spark, d).withColumn("day", F.date_trunc("day", F.col("ts").cast("timestamp_ntz")).cast("timestamp_ntz")).withColumn("k", F.when(F.col("k") % 3 != 0, F.col("k")))
    lists = lambda names, **how: windows.ordered_lists(e, ["user_id", "day"], ["ts", "event_id"], names, **how)
    out = lists({"kinds": "event_type", "ks": "k"}, null_text="-").join(lists({"known": "k"}), ["user_id", "day"])
    return out.withColumn("day", epoch_ms(F.col("day")))


@query("WITH {E} SELECT user_id, event_type, max(ms) AS latest_ms, count(*) AS n FROM e GROUP BY ALL")
def latest_per_key(spark, d):
    return ad.events(spark, d).groupBy("user_id", "event_type").agg(F.max(epoch_ms(F.col("ts"))).alias("latest_ms"), F.count(F.lit(1)).alias("n"))


@query("WITH {E} SELECT event_id, user_id, event_type, value, k FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM e) WHERE r = 1")
def latest_row(spark, d):
    return windows.latest_per_key(ad.events(spark, d).select("user_id", "ts", "event_id", "event_type", "value", "k"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("""WITH {E}, x AS (SELECT *, CASE event_type WHEN 'view' THEN 'A' WHEN 'click' THEN 'L' WHEN 'purchase' THEN 'F' ELSE 'X' END AS s FROM e),
    y AS (SELECT *, lag(s) OVER w AS p, lag(value) OVER w AS pv, last_value(CASE WHEN s <> 'L' THEN s END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM x WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, event_id, ms AS match_ms, pv AS last_value FROM y WHERE s = 'F' AND p = 'L' AND q = 'A'""")
def pattern_alf(spark, d):
    kind = F.col("event_type")
    out = patterns.match_a_lplus_f(ad.events(spark, d), by=["user_id"], order=["ts", "event_id"], a=kind == "view", l=kind == "click", f=kind == "purchase", measures={"event_id": F.col("event_id"), "ts": F.col("ts"), "last_value": ("last_l", F.col("value"))})
    return out.select("user_id", "event_id", ms("ts", "match_ms"), "last_value")


@query(ORACLE_SQL["pattern_alf"].replace("{E}", E).replace("event_id, ms AS match_ms, pv AS last_value", "event_id"))
def pattern_sequence(spark, d):
    kind = F.col("event_type")
    return patterns.match_sequence(ad.events(spark, d).select("user_id", "ts", "event_id", "event_type"), by=["user_id"], order=["ts", "event_id"], defines={"A": kind == "view", "L": kind == "click", "F": kind == "purchase"}, pattern="A L+ F", measures=lambda rows, text: {"event_id": rows["event_id"].iloc[-1]}, out_schema="user_id long, event_id long")


GENERAL = """WITH {E}, x AS (SELECT *, CASE event_type WHEN 'view' THEN 'A' WHEN 'click' THEN 'L' WHEN 'purchase' THEN 'F' ELSE 'X' END AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM e),
    y AS (SELECT *, coalesce(first_value(CASE WHEN s <> 'L' THEN CASE WHEN s = 'F' THEN n ELSE n - 1 END END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), max(n) OVER (PARTITION BY user_id)) AS z FROM x)
    SELECT y.user_id, y.event_id AS first_id, l.event_id AS last_id, y.z - y.n + 1 AS n FROM y JOIN x AS l ON l.user_id = y.user_id AND l.n = y.z WHERE y.s = 'A'"""


def _general(match, e, **how):
    kind = F.col("event_type")
    out = match(e, by=["user_id"], ts="ts", tiebreak=["event_id"], defines={"A": kind == "view", "L": kind == "click", "F": kind == "purchase"}, pattern="A L* F?", **how)
    return out.select("user_id", F.col("first.event_id").alias("first_id"), F.col("last.event_id").alias("last_id"), F.col("rows").alias("n"))


@query(GENERAL)
def pattern_general(spark, d):
    """The longest match from each view, in slices of ten days."""
    return _general(patterns.match_longest, ad.events(spark, d).select("user_id", "ts", "event_id", "event_type"), time_slice="10 days")


@query("""WITH {E}, x AS (SELECT *, CASE event_type WHEN 'view' THEN 'AIM' WHEN 'click' THEN 'LOCK' WHEN 'purchase' THEN 'FIRE' END AS a FROM e WHERE event_type <> 'signup'),
    h AS (SELECT user_id, ts, k / 100.0 AS rate, event_id FROM e WHERE event_type = 'signup'),
    j AS (SELECT x.*, h.rate, h.event_id AS h_id FROM x ASOF LEFT JOIN h ON x.user_id = h.user_id AND x.ts >= h.ts),
    z AS (SELECT *, CASE WHEN a = 'AIM' THEN 'A' WHEN a = 'LOCK' AND k < 80 THEN 'L' WHEN a = 'FIRE' AND value < 50 AND rate < 0.6 THEN 'F' ELSE 'X' END AS s FROM j),
    y AS (SELECT *, lag(s) OVER w AS p, lag(k) OVER w AS pk, lag(rate) OVER w AS prate, lag(h_id) OVER w AS ph, last_value(CASE WHEN s <> 'L' THEN s END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM z WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id AS player_id, ms AS match_ms, pk AS suspicious_reaction_time, round(prate, 4)::DOUBLE AS player_historical_hs_rate, ph AS player_matches_played FROM y WHERE s = 'F' AND p = 'L' AND q = 'A'""")
def suspicious_patterns(spark, d):
    e = ad.events(spark, d, "view", "click", "purchase", "error")
    kind = F.when(F.col("event_type") == "view", "AIM").when(F.col("event_type") == "click", "LOCK_ON_TARGET").when(F.col("event_type") == "purchase", "FIRE")
    actions = ad.feed(e, player_id=F.col("user_id"), action_type=kind, is_headshot=F.col("value") < 50, reaction_time_ms=F.col("k"), seq=F.col("event_id"))
    history = ad.feed(ad.events(spark, d, "signup"), player_id=F.col("user_id"), total_matches_played=F.col("event_id"), historical_headshot_rate=F.col("k") / 100.0)
    out = signals.suspicious_patterns(actions, history, max_reaction=80, max_rate=0.6)
    return out.select("player_id", ms("match_timestamp", "match_ms"), "suspicious_reaction_time", F.round("player_historical_hs_rate", 4).alias("player_historical_hs_rate"), "player_matches_played")


@query("""WITH {E} SELECT user_id, epoch_ms(date_trunc('day', ts)) AS day, string_agg(event_type, ',' ORDER BY ts, event_id) AS kinds, string_agg(k::VARCHAR, ',' ORDER BY ts, event_id) AS ks FROM e GROUP BY user_id, date_trunc('day', ts)""")
def ordered_lists(spark, d):
    e = ad.events(spark, d).withColumn("day", F.date_trunc("day", F.col("ts").cast("timestamp_ntz")).cast("timestamp_ntz"))
    return windows.ordered_lists(e, ["user_id", "day"], ["ts", "event_id"], {"kinds": "event_type", "ks": "k"}).withColumn("day", epoch_ms(F.col("day")))


VIEWER = """i AS (SELECT e.user_id, e.ts, e.event_type, c.k %% 3 AS g FROM (SELECT *, k %% 7 AS content FROM e WHERE event_type IN ('view', 'click')) e ASOF JOIN (SELECT *, k %% 7 AS content FROM e WHERE event_type = 'signup') c ON e.content = c.content AND e.ts >= c.ts),
    v AS (SELECT date_trunc('hour', ts) - to_hours(j) AS ws, user_id, 'g' || g AS genres, sum(CASE WHEN event_type = 'view' THEN 3 ELSE 1 END)::BIGINT AS weighted_interest_score_sum, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END)::BIGINT AS abandoned_views FROM i, (SELECT unnest(range(24))::BIGINT AS j) GROUP BY ws, user_id, g)""".replace("%%", "%")


def _interest(spark, d):
    e = ad.events(spark, d, "view", "click")
    seen = ad.feed(e, user_id=F.col("user_id"), content_id=F.col("k") % 7, event_type=F.when(F.col("event_type") == "view", "view_details").otherwise("hover"))
    content = ad.feed(ad.events(spark, d, "signup"), content_id=F.col("k") % 7, title=ad.s("event_id"), genres=F.concat(F.lit("g"), F.col("k") % 3))
    return viewer.viewer_interest(seen, content, size="24 hours", slide="1 hour", panes=True)


@query(f"WITH {{E}}, {VIEWER} SELECT epoch_ms(ws) AS window_start, epoch_ms(ws) + 86400000 AS window_end, user_id, genres, weighted_interest_score_sum, abandoned_views, false AS has_played_content FROM v")
def viewer_interest(spark, d):
    return bounds_in_ms(_interest(spark, d))


@query(f"""WITH {{E}}, {VIEWER} SELECT epoch_ms(ws) AS window_start, user_id, count(*) AS cnt, string_agg(genres, ',' ORDER BY genres) AS genres_list, string_agg(weighted_interest_score_sum::VARCHAR, ',' ORDER BY genres) AS weighted_interest_score_sum_list,
    sum(abandoned_views)::BIGINT AS abandoned_views_in_window FROM v GROUP BY ws, user_id HAVING sum(abandoned_views) > 2""")
def indecisive_viewers(spark, d):
    return viewer.indecisive_viewers(_interest(spark, d)).select(ms("window_start"), "user_id", "cnt", "genres_list", "weighted_interest_score_sum_list", "abandoned_views_in_window")


SOC = """a AS (SELECT e.ts, e.user_id, e.k %% 40 AS ip, e.value > 20 AS fail, e.k %% 2 = 0 AS mfa FROM e WHERE event_type = 'error'),
    f AS (SELECT ts, k %% 40 AS ip, (value * 1000000)::BIGINT AS bytes FROM e WHERE event_type = 'click'), g AS (SELECT ts, k %% 40 AS ip, event_id, CASE WHEN value > 10 THEN 'HIGH' ELSE 'LOW' END AS sev FROM e WHERE event_type = 'view'),
    j AS (SELECT a.*, f.bytes, g.event_id AS sig, g.sev FROM a JOIN f ON a.ip = f.ip AND f.ts BETWEEN a.ts - INTERVAL 2 HOUR AND a.ts + INTERVAL 2 HOUR LEFT JOIN g ON a.ip = g.ip AND g.ts BETWEEN a.ts - INTERVAL 2 HOUR AND a.ts + INTERVAL 2 HOUR),
    m AS (SELECT date_trunc('hour', ts) - to_hours(i) AS ws, user_id, ip, sum(fail::INT)::BIGINT AS failed_logins_5m, count(*) AS total_auth_events_5m, sum(mfa::INT)::BIGINT AS mfa_success_count_5m, sum(bytes)::BIGINT AS total_bytes_sent_5m,
        count(*) FILTER (sev = 'HIGH') AS high_critical_alerts_5m, count(sig) AS total_ids_alerts_5m FROM j, (SELECT unnest(range(6))::BIGINT AS i) GROUP BY ws, user_id, ip)""".replace("%%", "%")


def _soc_feeds(spark, d):
    ip = F.concat(F.lit("ip"), F.col("k") % 40)
    auth = ad.feed(ad.events(spark, d, "error"), user_id=ad.s("user_id"), src_ip=ip, location=F.lit("x"), device_id=F.lit("x"), outcome=F.when(F.col("value") > 20, "FAIL").otherwise("SUCCESS"), mfa_used=F.col("k") % 2 == 0)
    flows = ad.feed(ad.events(spark, d, "click"), src_ip=ip, dest_ip=F.lit("x"), dest_port=F.lit(1), protocol=F.lit("x"), bytes_sent=F.round(F.col("value") * 1000000).cast("bigint"))
    alerts = ad.feed(ad.events(spark, d, "view"), src_ip=ip, signature=ad.s("event_id"), severity=F.when(F.col("value") > 10, "HIGH").otherwise("LOW"))
    return auth, flows, alerts


@query(f"""WITH {{E}}, {SOC} SELECT epoch_ms(ws) AS window_start, epoch_ms(ws) + 21600000 AS window_end, user_id::VARCHAR AS user_id, 'ip' || ip AS src_ip, failed_logins_5m, total_auth_events_5m, mfa_success_count_5m, total_bytes_sent_5m, high_critical_alerts_5m, total_ids_alerts_5m,
    10 * failed_logins_5m + 5 * high_critical_alerts_5m + CASE WHEN total_bytes_sent_5m > 50000000 THEN 20 ELSE 0 END AS risk_score_5m FROM m""")
def security_risk_context(spark, d):
    return bounds_in_ms(soc.security_risk_context(*_soc_feeds(spark, d), within="2 hours", size="6 hours", slide="1 hour", bucketed=True, panes=True))


@query(f"""WITH {{E}}, {SOC.split(', j AS')[0] if ', j AS' in SOC else SOC.split('j AS')[0].rstrip().rstrip(',')},
    h AS (SELECT unnest(range(6))::BIGINT AS i), la AS (SELECT date_trunc('hour', ts) - to_hours(i) AS ws, user_id, ip, sum(fail::INT)::BIGINT AS failed, count(*) AS n, sum(mfa::INT)::BIGINT AS mfa FROM a, h GROUP BY ws, user_id, ip),
    lf AS (SELECT date_trunc('hour', ts) - to_hours(i) AS ws, ip, sum(bytes)::BIGINT AS bytes FROM f, h GROUP BY ws, ip), lg AS (SELECT date_trunc('hour', ts) - to_hours(i) AS ws, ip, count(*) FILTER (sev = 'HIGH') AS high, count(*) AS n FROM g, h GROUP BY ws, ip)
    SELECT epoch_ms(ws) AS window_start, user_id::VARCHAR AS user_id, 'ip' || ip AS src_ip, failed AS failed_logins_5m, la.n AS total_auth_events_5m, bytes AS total_bytes_sent_5m, coalesce(high, 0) AS high_critical_alerts_5m, coalesce(lg.n, 0) AS total_ids_alerts_5m,
    10 * failed + 5 * coalesce(high, 0) + CASE WHEN bytes > 50000000 THEN 20 ELSE 0 END AS risk_score_5m FROM la JOIN lf USING (ws, ip) LEFT JOIN lg USING (ws, ip)""")
def security_risk_deduped(spark, d):
    out = soc.security_risk_context(*_soc_feeds(spark, d), size="6 hours", slide="1 hour", dedupe=True, panes=True)
    return bounds_in_ms(out).drop("window_end", "mfa_success_count_5m")


@query(f"WITH {{E}}, {SOC} SELECT 'ip' || ip AS src_ip, failed_logins, bytes_sent FROM (SELECT ip, count(*) AS failed_logins FROM a WHERE fail GROUP BY ip HAVING count(*) >= 3) JOIN (SELECT ip, sum(bytes)::BIGINT AS bytes_sent FROM f GROUP BY ip HAVING sum(bytes) > 50000000) USING (ip)")
def combined_signals(spark, d):
    return soc.combined_signals(*_soc_feeds(spark, d)[:2])


@query(f"WITH {{E}}, {SOC} SELECT user_id::VARCHAR AS user_id, 'ip' || ip AS src_ip, sig::VARCHAR AS ids_signature, bytes AS bytes_sent FROM j WHERE sig IS NOT NULL AND ts > (SELECT max(ts) FROM j WHERE sig IS NOT NULL) - INTERVAL 5 DAY")
def recent_correlated_events(spark, d):
    return soc.recent_security_events(*_soc_feeds(spark, d), "5 days", within="2 hours").select("user_id", "src_ip", "ids_signature", "bytes_sent")


RISKS = f"{SOC}, r AS (SELECT *, 'ip' || ip AS src_ip, 10 * failed_logins_5m + 5 * high_critical_alerts_5m + CASE WHEN total_bytes_sent_5m > 50000000 THEN 20 ELSE 0 END AS risk_score_5m FROM m)"


@query(f"WITH {{E}}, {RISKS} SELECT src_ip, max(risk_score_5m) AS risk_score_5m FROM r WHERE ws = (SELECT max(ws) FROM r) GROUP BY src_ip ORDER BY risk_score_5m DESC, src_ip LIMIT 5")
def soc_top_risk(spark, d):
    return soc.top_risk_entities(soc.security_risk_context(*_soc_feeds(spark, d), within="2 hours", size="6 hours", slide="1 hour", panes=True))


@query(f"""WITH {{E}}, {RISKS} SELECT epoch_ms(ws) AS window_start, user_id::VARCHAR AS user_id, src_ip, risk_score_5m, risk_score_5m - lag(risk_score_5m) OVER w AS risk_score_5m_change, failed_logins_5m - lag(failed_logins_5m) OVER w AS failed_logins_5m_change,
    high_critical_alerts_5m - lag(high_critical_alerts_5m) OVER w AS high_critical_alerts_5m_change, total_bytes_sent_5m - lag(total_bytes_sent_5m) OVER w AS total_bytes_sent_5m_change, risk_score_5m > 30 AS is_high FROM r WINDOW w AS (PARTITION BY ip, user_id ORDER BY ws)""")
def soc_explain_risk(spark, d):
    out = soc.explain_risk(soc.security_risk_context(*_soc_feeds(spark, d), within="2 hours", size="6 hours", slide="1 hour", panes=True))
    return out.select(ms("window_start"), "user_id", "src_ip", "risk_score_5m", "risk_score_5m_change", "failed_logins_5m_change", "high_critical_alerts_5m_change", "total_bytes_sent_5m_change", "is_high")


@query("""WITH {E} SELECT o.o_orderkey, t.event_id AS transfer_id, a.event_id AS auth_id, h.event_id AS hold_id, d.event_id AS dispute_id, n.event_type AS last_message_type FROM (SELECT o_orderkey, o_custkey % 150 AS u, TIMESTAMP '2024-01-01' + to_hours(o_orderkey % 720) AS t FROM orders) o
    ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'purchase') t ON o.u = t.user_id AND o.t >= t.ts ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'click') a ON o.u = a.user_id AND o.t >= a.ts
    ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'error') h ON o.u = h.user_id AND o.t >= h.ts ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'signup') d ON o.u = d.user_id AND o.t >= d.ts
    ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'view') n ON o.u = n.user_id AND o.t >= n.ts""")
def support_context(spark, d):
    o = ad.table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 150).cast("string").alias("customer_id"), (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 720).cast("int"))).alias("event_time"))
    none, at = F.lit(None).cast("string"), epoch_ms(F.col("ts"))
    of = lambda kind, **c: ad.feed(ad.events(spark, d, kind), customer_id=ad.s("user_id"), **c)
    transfers = of("purchase", transfer_id=F.col("event_id"), type=none, amount=F.col("value"), status=none, failure_reason=none, expected_eta=at, tracking_ref=none, initiated_at=at, updated_at=at)
    auths = of("click", auth_id=F.col("event_id"), merchant=none, amount=F.col("value"), status=none, expected_settlement_at=at, created_at=at)
    holds = of("error", hold_id=F.col("event_id"), reason_code=none, status=none, release_conditions=none, velocity_limit_per_hour=F.col("k"))
    disputes = of("signup", dispute_id=F.col("event_id"), stage=none, provisional_credit_status=none, next_required_action=none, updated_at=at)
    notes = of("view", message_type=F.col("event_type"), message=none, sent_at=at)
    return bank.support_context(o, transfers, auths, holds, disputes, notes).select("o_orderkey", "transfer_id", "auth_id", "hold_id", "dispute_id", "last_message_type")


@query("""WITH {E} SELECT epoch_ms(time_bucket(INTERVAL 30 MINUTE, ts)) AS window_start, user_id AS customer_id, count(*) AS transfer_events_30m, round(sum(value), 4) AS transfer_amount_30m, max(ms) AS last_transfer_update_at FROM e WHERE event_type = 'purchase' GROUP BY time_bucket(INTERVAL 30 MINUTE, ts), user_id""")
def transfer_stats(spark, d):
    feed = ad.feed(ad.events(spark, d, "purchase"), customer_id=F.col("user_id"), amount=F.col("value"), updated_at=epoch_ms(F.col("ts")))
    out = bank.activity_stats(feed, "transfer", "updated_at", "last_transfer_update_at")
    return bounds_in_ms(out).drop("window_end").withColumn("transfer_amount_30m", F.round("transfer_amount_30m", 4))


@query("""WITH {E} SELECT epoch_ms(time_bucket(INTERVAL 30 MINUTE, ts)) AS window_start, user_id AS customer_id, count(*) AS auth_events_30m, round(sum(value), 4) AS auth_amount_30m, max(ms) AS last_auth_at FROM e WHERE event_type = 'click' GROUP BY time_bucket(INTERVAL 30 MINUTE, ts), user_id""")
def auth_stats(spark, d):
    auths = ad.feed(ad.events(spark, d, "click"), customer_id=F.col("user_id"), amount=F.col("value"), created_at=epoch_ms(F.col("ts")))
    out = bank.activity_stats(auths, "auth", "created_at", "last_auth_at")
    return out.select(ms("window_start"), "customer_id", "auth_events_30m", F.round("auth_amount_30m", 4).alias("auth_amount_30m"), "last_auth_at")


@query("WITH {E} SELECT user_id AS customer_id, max(ms) FILTER (event_type = 'purchase') AS last_transfer_at, max(ms) FILTER (event_type = 'click') AS last_auth_at, max(ms) FILTER (event_type = 'view') AS last_notification_at FROM e GROUP BY user_id HAVING count(*) FILTER (event_type IN ('purchase', 'click', 'view')) > 0")
def latest_times(spark, d):
    """The latest transfer, authorisation and notification of each customer."""
    of = lambda kind, name: bank.latest_time_per_customer(ad.feed(ad.events(spark, d, kind), customer_id=F.col("user_id"), at=epoch_ms(F.col("ts"))), "at", name)
    return of("purchase", "last_transfer_at").join(of("click", "last_auth_at"), "customer_id", "full").join(of("view", "last_notification_at"), "customer_id", "full")


@query("WITH {E} SELECT event_id, event_type, k FROM e WHERE user_id = 7 AND event_type = 'error'")
def lookup(spark, d):
    return joins.lookup(ad.events(spark, d), user_id=7, event_type="error").select("event_id", "event_type", "k")


@query(r"SELECT page_id, string_split(url, '/')[3] AS host, CASE WHEN len(string_split(url, '/')) >= 5 THEN string_split(url, '/')[5] END AS page FROM pages")
def split_trace(spark, d):
    url = F.col("url")
    return ad.table(spark, d, "pages").select("page_id", split_index(url, "/", 2).alias("host"), split_index(url, "/", 5, base=1).alias("page"))


@query(r"SELECT page_id, nullif(regexp_extract(url, '[0-9]+'), '') AS number, nullif(regexp_extract(url, '^https?'), '') AS scheme FROM pages")
def regex_ids(spark, d):
    return ad.table(spark, d, "pages").select("page_id", match_text(F.col("url"), "[0-9]+").alias("number"), match_text(F.col("url"), "^https?").alias("scheme"))


@query("SELECT event_id, regexp_extract(props, '[0-9]+') AS k, NULL::VARCHAR AS missing FROM events")
def json_values(spark, d):
    return ad.table(spark, d, "events").select("event_id", json_value(F.col("props"), "$.k").alias("k"), json_value(F.col("props"), "$.x").alias("missing"))


AUDIT = """u AS (SELECT date_trunc('milliseconds', ts) AS t, 'com.oraclecloud.' || event_type AS audittype, event_id, user_id, k, event_type, CASE WHEN k %% 2 = 0 THEN 'opc' || user_id END AS opc, CASE WHEN k %% 3 <> 0 THEN k::VARCHAR END AS trace, CASE WHEN k %% 3 = 2 THEN user_id::VARCHAR END AS span,
    (200 + (k %% 4) * 100)::VARCHAR AS status, ['GET', 'POST', 'PUT', 'DELETE'][k %% 4 + 1] AS act FROM e WHERE event_type <> 'view'),
    l AS (SELECT date_trunc('milliseconds', ts) AS t, event_id, user_id, CASE WHEN k %% 2 = 0 THEN 'opc' || user_id END AS opc, CASE WHEN k %% 2 = 1 THEN k::VARCHAR END AS trace,
        CASE WHEN k %% 3 = 0 THEN 'Processing failed for ocid1.fn.oc1.iad.a' || event_id WHEN k %% 3 = 1 THEN 'error: timeout' WHEN k < 90 THEN 'plain' END AS message FROM e WHERE event_type = 'view')""".replace("%%", "%")


def _audit(spark, d):
    return cloudlogs.normalize_audit(ad.audit_raw(ad.events(spark, d, "signup", "error", "click", "purchase")))


def _logs(spark, d):
    return cloudlogs.normalize_function_logs(ad.function_log_raw(ad.events(spark, d, "view")))


@query(f"WITH {{E}}, {AUDIT} SELECT epoch_ms(t) AS audit_ms, audittype, event_id::VARCHAR AS resourceid, status AS responsestatus, opc AS opcrequestid, trace AS traceid, span AS spanid, k::VARCHAR AS eventtraceid, coalesce(opc, trace, k::VARCHAR) AS best_request_correlation, coalesce(trace, k::VARCHAR) AS besttraceid FROM u")
def audit_normalized(spark, d):
    return _audit(spark, d).select(ms("audittime", "audit_ms"), "audittype", "resourceid", "responsestatus", "opcrequestid", "traceid", "spanid", "eventtraceid", "best_request_correlation", "besttraceid")


@query(ORACLE_SQL["audit_normalized"])
def audit_from_text(spark, d):
    """audit_normalized from broker records whose values are JSON text."""
    records = io.to_broker(ad.audit_raw(ad.events(spark, d, "signup", "error", "click", "purchase")).withColumn("unknown", F.lit(1)))
    raw = records.select(F.from_json("value", schemas.AUDIT_RAW).alias("v")).select("v.*")
    return cloudlogs.normalize_audit(raw).select(ms("audittime", "audit_ms"), "audittype", "resourceid", "responsestatus", "opcrequestid", "traceid", "spanid", "eventtraceid", "best_request_correlation", "besttraceid")


@query(f"WITH {{E}}, {AUDIT} SELECT epoch_ms(t) AS log_ms, event_id::VARCHAR AS functionid, opc AS opcrequestid, trace AS besttraceid, message, CASE WHEN message LIKE 'P%' THEN 'ocid1.fn.oc1.iad.a' || event_id END AS containerinstance_ocid, CASE WHEN message LIKE 'P%' THEN 'Processing' END AS lifecycle_phase FROM l WHERE message IS NOT NULL")
def function_logs_normalized(spark, d):
    return _logs(spark, d).select(ms("logtime", "log_ms"), "functionid", "opcrequestid", "besttraceid", "message", "containerinstance_ocid", "lifecycle_phase")


@query(f"WITH {{E}}, {AUDIT} SELECT event_id::VARCHAR AS resourceid, status AS responsestatus FROM u WHERE status >= '4' AND t > (SELECT max(t) FROM u) - INTERVAL 2 DAY")
def failed_requests(spark, d):
    return cloudlogs.failed_requests(_audit(spark, d), "2 days").select("resourceid", "responsestatus")


@query(f"WITH {{E}}, {AUDIT} SELECT event_id::VARCHAR AS resourceid, act AS requestaction FROM u WHERE act <> 'GET' AND t > (SELECT max(t) FROM u) - INTERVAL 2 DAY")
def write_actions(spark, d):
    return cloudlogs.write_actions(_audit(spark, d), "2 days").select("resourceid", "requestaction")


@query(f"WITH {{E}}, {AUDIT} SELECT event_id::VARCHAR AS functionid, message FROM l WHERE message <> 'plain' AND t > (SELECT max(t) FROM l WHERE message IS NOT NULL) - INTERVAL 2 DAY")
def error_logs(spark, d):
    return cloudlogs.error_logs(_logs(spark, d), "2 days").select("functionid", "message")


@query(f"""WITH {{E}}, {AUDIT}, w AS (SELECT *, coalesce(trace, k::VARCHAR) AS best FROM u WHERE act <> 'GET'), er AS (SELECT * FROM l WHERE message <> 'plain'),
    m AS (SELECT er.event_id, w.event_id AS a FROM er JOIN w ON er.opc = w.opc AND abs(epoch_ms(er.t) - epoch_ms(w.t)) <= 43200000)
    SELECT event_id::VARCHAR AS functionid, a::VARCHAR AS audit_resourceid, 'opcrequestid' AS matched_on FROM m
    UNION ALL SELECT er.event_id::VARCHAR, w.event_id::VARCHAR, 'besttraceid' FROM er JOIN w ON er.trace = w.best AND abs(epoch_ms(er.t) - epoch_ms(w.t)) <= 43200000 WHERE er.event_id NOT IN (SELECT event_id FROM m)""")
def correlate(spark, d):
    return cloudlogs.trace_errors_to_actions(_logs(spark, d), _audit(spark, d), "12 hours").select("functionid", "audit_resourceid", "matched_on")


@query("""WITH {E} SELECT epoch_ms(date_trunc('day', ts)) AS window_start, user_id::VARCHAR AS patient_id, round(avg(k), 4) AS avg_hr_15m, round(stddev_samp(k), 4) AS stddev_hr_15m, round(avg(k + 1), 4) AS avg_rr_15m, max(value) AS max_temp_c_15m FROM e GROUP BY date_trunc('day', ts), user_id""")
def vital_features(spark, d):
    feed = ad.feed(ad.events(spark, d), patient_id=ad.s("user_id"), heart_rate_bpm=F.col("k"), respiratory_rate_rpm=F.col("k") + 1, skin_temp_c=F.col("value"))
    out = bounds_in_ms(signals.vital_features(feed, "1 day")).drop("window_end")
    return out.select("window_start", "patient_id", *[F.round(c, 4).alias(c) for c in ("avg_hr_15m", "stddev_hr_15m", "avg_rr_15m")], "max_temp_c_15m")


@query("""SELECT user_id, CAST(length('User ' || user_id || ' did ' || n || ' things') % 100 AS DOUBLE) / 100 AS risk_score, length('User ' || user_id || ' did ' || n || ' things') || ' characters' AS justification FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)""")
def model_replies(spark, d):
    from .functions.scalars import prompt

    n = ad.events(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    asked = enrich_with_model(n.withColumn("prompt", prompt("User ", F.col("user_id"), " did ", F.col("n"), " things")), "prompt")
    return parse_model_reply(asked, "model_reply", ["risk_score", "justification"]).select("user_id", F.col("risk_score").cast("double").alias("risk_score"), "justification")


SHOP = """x AS (SELECT *, date_trunc('day', ts) AS w FROM e WHERE event_type <> 'signup'),
    c AS (SELECT w, user_id, string_agg(CASE WHEN k % 6 = 5 THEN '/checkout' ELSE '/p' || k % 6 END, ',' ORDER BY ts, CASE WHEN k % 6 = 5 THEN '/checkout' ELSE '/p' || k % 6 END) FILTER (event_type IN ('view', 'click')) AS pages,
        count(DISTINCT k % 6) FILTER (event_type IN ('view', 'click')) AS n_pages, (count(*) FILTER (event_type = 'purchase' AND k % 2 = 0))::BIGINT AS adds, string_agg('m' || k, ',' ORDER BY ts, 'm' || k) FILTER (event_type = 'error') AS chats FROM x GROUP BY w, user_id)"""


def _shoppers(spark, d):
    page = F.when(F.col("k") % 6 == 5, "/checkout").otherwise(F.concat(F.lit("/p"), F.col("k") % 6))
    pages = ad.feed(ad.events(spark, d, "view", "click"), user_id=F.col("user_id"), page=page)
    carts = ad.feed(ad.events(spark, d, "purchase"), user_id=F.col("user_id"), cart_action=F.when(F.col("k") % 2 == 0, "ADD").otherwise("REMOVE"))
    chats = ad.feed(ad.events(spark, d, "error"), user_id=F.col("user_id"), message=F.concat(F.lit("m"), F.col("k")))
    return signals.shopper_context(pages, carts, chats, size="1 day")


@query(f"WITH {{E}}, {SHOP} SELECT epoch_ms(w) AS window_start, user_id, coalesce(pages, '') AS page_visited_list, n_pages AS distinct_pages_visited_10m, adds AS items_added_to_cart_10m, chats AS chat_message_list FROM c")
def shopper_context(spark, d):
    return bounds_in_ms(_shoppers(spark, d)).drop("window_end")


@query(f"WITH {{E}}, {SHOP} SELECT epoch_ms(w) AS window_start, user_id, CASE WHEN n_pages >= 3 AND adds = 0 THEN 'chat' WHEN pages LIKE '%/checkout' AND chats IS NULL THEN 'discount' ELSE 'none' END AS action FROM c")
def next_action(spark, d):
    return signals.next_best_action(_shoppers(spark, d), min_pages=3).select(ms("window_start"), "user_id", "action")


@query("""WITH {E}, b AS (SELECT b.event_id, b.k % 50 AS flight, b.ts, b.user_id, p.k AS pk, p.event_id AS pid FROM (SELECT * FROM e WHERE event_type = 'click') b ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'signup') p ON b.user_id = p.user_id AND b.ts >= p.ts)
    SELECT b.user_id::VARCHAR AS passenger_id, 'f' || b.pid || ' l' AS full_name, CASE WHEN b.pk % 4 = 0 THEN 'PLATINUM' ELSE 'GOLD' END AS loyalty_tier, f.event_id::VARCHAR AS origin, CASE WHEN f.k % 3 = 0 THEN 'CANCELED' ELSE 'DELAYED' END AS flight_status
    FROM (SELECT * FROM e WHERE event_type = 'error' AND k % 3 < 2) f JOIN b ON f.k % 50 = b.flight AND b.ts BETWEEN f.ts - INTERVAL 1 DAY AND f.ts + INTERVAL 1 DAY WHERE b.pk % 4 < 2""")
def disrupted_premium_passengers(spark, d):
    k = F.col("k")
    flights = ad.feed(ad.events(spark, d, "error"), flight_id=k % 50, flight_status=F.when(k % 3 == 0, "CANCELED").when(k % 3 == 1, "DELAYED").otherwise("ON_TIME"), origin=ad.s("event_id"), destination=F.lit("x"))
    bookings = ad.feed(ad.events(spark, d, "click"), booking_id=ad.s("event_id"), flight_id=k % 50, passenger_id=ad.s("user_id"), seat=F.lit("1A"))
    profiles = ad.feed(ad.events(spark, d, "signup"), passenger_id=ad.s("user_id"), first_name=F.concat(F.lit("f"), "event_id"), last_name=F.lit("l"), loyalty_tier=F.when(k % 4 == 0, "PLATINUM").when(k % 4 == 1, "GOLD").otherwise("SILVER"), preferences=F.struct(F.lit("aisle").alias("seating")))
    return incidents.disrupted_premium_passengers(flights, bookings, profiles, bucketed=True).select("passenger_id", "full_name", "loyalty_tier", "origin", "flight_status")


@query("""SELECT n_name AS nation, o_orderpriority AS priority, count(*) AS items, sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4)))::DOUBLE AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def star_enrich(spark, d):
    t = lambda n: ad.table(spark, d, n)
    items = t("lineitem").select("l_orderkey", "l_extendedprice", "l_discount").join(t("orders").select("o_orderkey", "o_custkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    of = t("customer").select("c_custkey", "c_nationkey").join(F.broadcast(t("nation").select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    out = items.join(of, F.col("o_custkey") == F.col("c_custkey"))
    return out.groupBy(F.col("n_name").alias("nation"), F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("items"), F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")).cast("double").alias("revenue"))


def _replayed(spark, d, build, closing="user_id <> -1", **how):
    """A streaming query over events, in several micro-batches in the order of time, and one far later event of each type, of user -1, which moves the watermark past all others and isn't shown."""
    e = ad.events(spark, d).select("event_id", "user_id", "ts", "event_type", "value", "k")
    kinds = F.explode(F.array(*[F.lit(x) for x in ("signup", "error", "click", "view", "purchase")]))
    last = e.agg((F.max("ts") + F.expr("INTERVAL 100 DAYS")).alias("ts")).where("ts IS NOT NULL")
    ends = last.select(F.lit(-1).cast("bigint").alias("event_id"), F.lit(-1).cast("bigint").alias("user_id"), "ts", kinds.alias("event_type"), F.lit(0.0).alias("value"), F.lit(0).cast("bigint").alias("k"))
    return replay(e.unionByName(ends), lambda s: build(s.withColumn("ts", F.col("ts").cast("timestamp"))), ts="ts", **how).where(closing)


@query(ORACLE_SQL["tumble_stats"].replace(", round(sum(value), 4) AS total", "").replace("count(DISTINCT event_type) AS kinds, ", "count(DISTINCT event_type) AS kinds, "))
def stream_tumble(spark, d):
    aggs = [F.count(F.lit(1)).alias("n"), F.size(F.collect_set("event_type")).cast("long").alias("kinds"), F.sum(F.when(F.col("value") > 100, 1).otherwise(0)).alias("high"), F.max(epoch_ms(F.col("ts"))).alias("last_at")]
    return _replayed(spark, d, lambda s: bounds_in_ms(windows.tumble_agg(s, ["user_id"], "1 hour", aggs, ts="ts", watermark="10 seconds")))


@query(ORACLE_SQL["hop_risk"])
def stream_hop(spark, d):
    parts = {"errors": ("sum", F.when(F.col("event_type") == "error", 1).otherwise(0)), "n": ("count", F.lit(1)), "most": ("max", F.col("value"))}
    risk = 10 * F.col("errors") + F.when(F.col("most") > 100, 20).otherwise(0)
    return _replayed(spark, d, lambda s: bounds_in_ms(windows.hop_agg(s, ["user_id"], "6 hours", "1 hour", parts, ts="ts", watermark="10 seconds").withColumn("risk", risk)))


@query(ORACLE_SQL["asof_left"])
def stream_asof(spark, d):
    def build(s):
        facts = s.where("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")
        versions = s.where("event_type = 'signup'").select("user_id", "ts", "event_id", "value")
        out = stateful.asof_stream(facts, versions, on=["user_id"], left_ts="ts", right_ts="ts", prefix="v_")
        return out.select("event_id", "user_id", "value", "v_event_id", "v_value", ms("v_ts", "v_ms"))

    return _replayed(spark, d, build)


@query(ORACLE_SQL["pattern_alf"])
def stream_pattern(spark, d):
    kind = F.col("event_type")

    def build(s):
        measures = lambda last, f: [f["user_id"].alias("user_id"), f["event_id"].alias("event_id"), epoch_ms(f["ts"]).alias("match_ms"), last["value"].alias("last_value")]
        return stateful.match_stream(s, by=["user_id"], ts="ts", tiebreak="event_id", a=kind == "view", l=kind == "click", f=kind == "purchase", measures=measures)

    return _replayed(spark, d, build)


@query(ORACLE_SQL["interval_left"])
def stream_interval_left(spark, d):
    def build(s):
        left = s.where("event_type = 'error'").select("user_id", "ts", "event_id").withWatermark("ts", "10 seconds")
        right = s.where("event_type = 'click'").select("user_id", F.col("ts").alias("r_ts"), F.col("event_id").alias("r_event_id")).withWatermark("r_ts", "10 seconds")
        return joins.interval_join(left, right, on=["user_id"], left_ts="ts", right_ts="r_ts", within="6 hours", how="left").select("user_id", "event_id", "r_event_id")

    return _replayed(spark, d, build)


@query("""WITH {E}, p AS (SELECT *, date_trunc('day', ts) AS t FROM e WHERE event_type = 'purchase'), s AS (SELECT *, date_trunc('day', ts) AS t FROM e WHERE event_type <> 'purchase'),
    v AS (SELECT user_id, t, max(k) AS k FROM s WHERE user_id IS NOT NULL GROUP BY user_id, t)
    SELECT p.event_id, p.user_id, v.k AS v_k FROM (SELECT event_id, user_id, CASE WHEN k % 7 = 0 THEN NULL ELSE user_id END AS own, t FROM p) p ASOF LEFT JOIN v ON p.own = v.user_id AND p.t >= v.t""")
def stream_asof_ties(spark, d):
    """Versions of equal time, ordered by number; every seventh fact has no key."""

    def build(s):
        s = s.withColumn("t", F.date_trunc("day", "ts"))
        facts = s.where("event_type = 'purchase'").select(F.when((F.col("k") % 7 != 0) | (F.col("user_id") < 0), F.col("user_id")).alias("own"), "t", "event_id", "user_id")
        versions = s.where("event_type <> 'purchase'").select(F.col("user_id").alias("own"), F.col("t").alias("vt"), "k")
        return stateful.asof_stream(facts, versions, on=["own"], left_ts="t", right_ts="vt", tiebreak="k", prefix="v_").select("event_id", "user_id", "v_k")

    return _replayed(spark, d, build)


@query(ORACLE_SQL["security_risk_context"])
def stream_security_risk(spark, d):
    """The security job as one stream: two interval joins and a hopping window, each with state."""

    def build(s):
        s = s.withColumn("ip", F.when(F.col("user_id") < 0, "closing").otherwise(F.concat(F.lit("ip"), F.col("k") % 40)))
        of = lambda kind, **cols: s.where(F.col("event_type") == kind).select(F.col("ts").alias("event_time"), F.col("ip").alias("src_ip"), *[c.alias(n) for n, c in cols.items()])
        auth = of("error", user_id=ad.s("user_id"), location=F.lit("x"), device_id=F.lit("x"), outcome=F.when(F.col("value") > 20, "FAIL").otherwise("SUCCESS"), mfa_used=F.col("k") % 2 == 0)
        flows = of("click", dest_ip=F.lit("x"), dest_port=F.lit(1), protocol=F.lit("x"), bytes_sent=F.round(F.col("value") * 1000000).cast("bigint"))
        alerts = of("view", signature=ad.s("event_id"), severity=F.when(F.col("value") > 10, "HIGH").otherwise("LOW"))
        out = soc.security_risk_context(auth, flows, alerts, within="2 hours", size="6 hours", slide="1 hour", watermark="10 seconds")
        return bounds_in_ms(out)

    return _replayed(spark, d, build)


@query(ORACLE_SQL["latest_row"])
def stream_latest(spark, d):
    """The latest row of each user, in update mode."""
    return _replayed(spark, d, lambda s: stateful.latest_stream(s, ["user_id"], ["ts", "event_id"]).drop("ts"), keys=["user_id"])


@query(ORACLE_SQL["asof_enrich"])
def stream_asof_enrich(spark, d):
    """Four change feeds in one keyed operator."""

    def build(s):
        of = lambda kind: s.where(F.col("event_type") == kind).select("user_id", "ts", "event_id")
        kinds = ("signup", "view", "error", "click")
        out = stateful.asof_enrich_stream(of("purchase"), {k: (of(k), "ts") for k in kinds}, on=["user_id"], ts="ts", tiebreak="event_id")
        return out.select("event_id", *[F.col(f"{k}.event_id").alias(f"{k}_id") for k in kinds])

    return _replayed(spark, d, build, closing="event_id <> -1")


@query(ORACLE_SQL["asof_window_feature"])
def stream_asof_window_feature(spark, d):
    """The results of a window as a change feed, in one streaming query."""

    def build(s):
        s = s.withWatermark("ts", "10 seconds")
        stats = windows.tumble_agg(s, ["user_id"], "1 day", [F.count(F.lit(1)).alias("n")], ts="ts", window_col="window")
        stats = stats.select("user_id", "window_end", "n", F.window_time("window").alias("at"))
        facts = s.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
        out = stateful.asof_stream(facts, stats, on=["user_id"], left_ts="ts", right_ts="window_end", event_time="at", watermark=None)
        return out.select("event_id", "n", ms("window_end", "w"))

    return _replayed(spark, d, build, closing="event_id <> -1")


@query(ORACLE_SQL["aml_alerts"])
def stream_aml_alerts(spark, d):
    """The alerts as one stream: a window's results and three change feeds, joined by one keyed operator."""

    def build(s):
        of = lambda kind: s.where(F.col("event_type") == kind).withColumn("props", F.lit(None).cast("string"))
        out = aml.aml_alerts(ad.transactions(of("purchase")), ad.customers(of("signup")), ad.kyc_results(of("view")), ad.sanctions(of("error")), window="1 day")
        return _shown(out)

    return _replayed(spark, d, build, closing="customer_id <> '-1'")


@query(ORACLE_SQL["indecisive_viewers"])
def stream_indecisive_viewers(spark, d):
    """Three stateful operators one after the other: an as-of join, sums of panes, and lists of panes from which hopping windows are read."""

    def build(s):
        seen = ad.feed(s.where("event_type IN ('view', 'click')"), user_id=F.col("user_id"), content_id=F.col("k") % 7, event_type=F.when(F.col("event_type") == "view", "view_details").otherwise("hover"))
        content = ad.feed(s.where("event_type = 'signup'"), content_id=F.col("k") % 7, title=ad.s("event_id"), genres=F.concat(F.lit("g"), F.col("k") % 3))
        out = viewer.indecisive_viewers_stream(seen, content, size="24 hours", slide="1 hour")
        return out.select(ms("window_start"), "user_id", "cnt", "genres_list", "weighted_interest_score_sum_list", "abandoned_views_in_window")

    return _replayed(spark, d, build)


@query(GENERAL)
def stream_pattern_general(spark, d):
    return _replayed(spark, d, lambda s: _general(stateful.match_longest_stream, s.select("user_id", "ts", "event_id", "event_type"), idle="60 days"))


@query("""WITH {E}, p AS (SELECT *, date_trunc('day', ts) AS t FROM e WHERE event_type = 'purchase'), s AS (SELECT *, date_trunc('day', ts) AS t FROM e WHERE event_type <> 'purchase'),
    v AS (SELECT user_id, t, max((k - 50) * 0.25::DOUBLE) AS v FROM s GROUP BY user_id, t) SELECT p.event_id, v.v AS v_v FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.t >= v.t""")
def asof_ties(spark, d):
    """Versions of equal time, ordered by negative and fractional numbers."""
    e = ad.events(spark, d).withColumn("t", F.date_trunc("day", F.col("ts").cast("timestamp_ntz")).cast("timestamp_ntz"))
    versions = e.where("event_type <> 'purchase'").select("user_id", F.col("t").alias("vt"), ((F.col("k") - 50) * F.lit(0.25)).alias("v"))
    return joins.asof_join(e.where("event_type = 'purchase'").select("user_id", "t", "event_id"), versions, on=["user_id"], left_ts="t", right_ts="vt", tiebreak="v", prefix="v_").select("event_id", "v_v")


@query(ORACLE_SQL["latest_row"])
def view_current(spark, d):
    """A keyed view that four batches write to, one after the other, with whole versions between."""
    path = f"{shared_dir(spark)}/view-{uuid.uuid4().hex}"
    rows = ad.events(spark, d).select("user_id", "ts", "event_id", "event_type", "value", "k")
    for part in range(4):
        io.materialize(rows.where(F.col("event_id") % 4 == part), path, keys=["user_id"], version_col="ts", changes=2, buckets=4)
    return io.read_view(spark, path).drop("ts")


@query("WITH {E} SELECT user_id, event_id, event_type, ms AS at FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ms ORDER BY event_id DESC) AS r FROM e) WHERE r = 1")
def changelog_from_files(spark, d):
    """A keyed change feed, written as JSON records and read by its schema: each version of each key once."""
    path = f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"
    rows = ad.events(spark, d).select("user_id", "event_id", "event_type", ms("ts", "at"), F.lit(1).alias("unknown"))
    io.to_broker(rows).write.text(path)
    feed = io.read_changelog(spark, path, "user_id long, event_id long, event_type string, at long, missing string", keys=["user_id"], version_col="at", tiebreak="event_id")
    return feed.select("user_id", "event_id", "event_type", epoch_ms(F.col("event_time")).alias("at"))


@query(ORACLE_SQL["correlate"])
def stream_correlate(spark, d):
    """The correlation job as one stream: what the join by the first key gives up at the watermark feeds the join by the second."""

    def build(s):
        s = s.withColumn("props", F.lit("x")).withColumn("k", F.when(F.col("user_id") < 0, 1).otherwise(F.col("k")))  # closing rows pass both filters
        logs = cloudlogs.normalize_function_logs(ad.function_log_raw(s.where("event_type = 'view'")))
        audit = cloudlogs.normalize_audit(ad.audit_raw(s.where("event_type <> 'view'")))
        return cloudlogs.trace_errors_to_actions(logs, audit, "12 hours").select("functionid", "audit_resourceid", "matched_on")

    return _replayed(spark, d, build, closing="functionid <> '-1'")
