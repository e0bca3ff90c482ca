"""The jobs over planted rows with known results."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from streamctx.plans import aml, bank, cloudlogs, incidents, signals, soc, viewer
from streamctx.sources import schemas
from streamctx.sources.io import with_event_time

T0 = 1704067200000
H = 3600_000


def feed(spark, schema, time_col, rows, unit="ms"):
    """A feed from dicts; missing columns are NULL."""
    names = spark.createDataFrame([], schema).columns
    return with_event_time(spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema), time_col, unit)


def ts(seconds):
    return datetime(2024, 1, 1) + timedelta(seconds=seconds)


def aml_feeds(spark, txns, customers=(), kyc=(), sanctions=()):
    return (
        feed(spark, schemas.TRANSACTIONS, "tx_timestamp", txns),
        feed(spark, schemas.CUSTOMERS, "updated_at", customers),
        feed(spark, schemas.KYC_RESULTS, "completed_at", kyc),
        feed(spark, schemas.SANCTIONS, "reviewed_at", sanctions),
    )


def txn(i, amount, t):
    from decimal import Decimal

    return {"transaction_id": f"t{i}", "customer_id": "c", "amount": Decimal(amount), "country_code": "DE", "tx_timestamp": t}


def test_aml_score(spark):
    feeds = aml_feeds(spark, [txn(i, 1, T0 + i) for i in range(3)] + [txn(9, 15000, T0 + H)], [{"customer_id": "c", "pep_flag": True, "kyc_status": "PASSED", "updated_at": T0 - 5}], [{"customer_id": "c", "risk_level": "HIGH", "completed_at": T0 - 5}])
    got = {r.transaction_id: r for r in aml.aml_alerts(*feeds).collect()}
    assert got["t9"].base_score == 0.8 and got["t9"].txn_count_1h == 3 and got["t9"].alert_reason.endswith("from DE for customer c")
    assert got["t0"].txn_count_1h is None and got["t0"].base_score == 0.4
    assert len(next(iter(got.values()))) == 41
    assert {r.alert_id for r in aml.aml_alerts(*feeds).collect()} == {r.alert_id for r in got.values()}


def test_aml_by_kyc_or_sanction_status(spark):
    feeds = aml_feeds(spark, [txn(1, 100, T0)], sanctions=[{"customer_id": "c", "status": "POTENTIAL", "reviewed_at": T0 - 1}])
    assert aml.aml_alerts(*feeds).count() == 0
    (r,) = aml.aml_alerts(*feeds, status_col="sanction_status").collect()
    assert r.base_score == 0.15
    assert [x.customer_id for x in aml.customers_with_potential_sanctions(aml.aml_alerts(*feeds, status_col="sanction_status")).collect()] == ["c"]


def test_support_context(spark):
    ledger = feed(spark, schemas.LEDGER_UPDATES, "updated_at", [{"customer_id": "c", "event_id": "e1", "updated_at": T0}, {"customer_id": "c", "event_id": "e2", "updated_at": T0 + 10}])
    transfers = feed(spark, schemas.TRANSFERS, "updated_at", [{"customer_id": "c", "transfer_id": "x", "type": "ACH", "updated_at": T0 + 5}])
    empty = [feed(spark, s, t, []) for s, t in ((schemas.AUTH_EVENTS, "created_at"), (schemas.HOLDS, "created_at"), (schemas.DISPUTES, "created_at"))]
    notes = feed(spark, schemas.NOTIFICATIONS, "sent_at", [{"customer_id": "c", "message": m, "sent_at": T0 + t} for m, t in (("a", 1), ("b", 2), ("late", 99))])
    got = {r.event_id: (r.transfer_id, r.transfer_type, r.auth_id, r.last_message) for r in bank.support_context(ledger, transfers, *empty, notes).collect()}
    assert got == {"e1": (None, None, None, None), "e2": ("x", "ACH", None, "b")}
    assert bank.support_context(ledger, transfers, *empty, notes, mode="all").count() == 6


def test_soc_fan_out(spark):
    auth = feed(spark, schemas.LOGINS, "event_timestamp", [{"event_timestamp": T0, "user_id": "u", "src_ip": "i", "outcome": "FAIL", "mfa_used": False}])
    flows = feed(spark, schemas.NETWORK_FLOWS, "event_timestamp", [{"event_timestamp": T0, "src_ip": "i", "bytes_sent": 30_000_000}] * 2)
    alerts = feed(spark, schemas.IDS_ALERTS, "event_timestamp", [{"event_timestamp": T0, "src_ip": "i", "signature": "s", "severity": "HIGH"}] * 2)
    got = soc.security_risk_context(auth, flows, alerts).collect()
    assert len(got) == 10 and {(r.failed_logins_5m, r.high_critical_alerts_5m, r.total_bytes_sent_5m, r.risk_score_5m) for r in got} == {(4, 4, 120_000_000, 80)}
    apart = soc.security_risk_context(auth, flows, alerts, dedupe=True).collect()
    assert {(r.failed_logins_5m, r.high_critical_alerts_5m, r.risk_score_5m) for r in apart} == {(1, 2, 40)}
    ctx = soc.security_risk_context(auth, flows, alerts)
    assert [r.src_ip for r in soc.top_risk_entities(ctx).collect()] == ["i"]
    assert {r.risk_score_5m_change for r in soc.explain_risk(ctx, src_ip="i").collect()} == {None, 0}


def test_kill_chain(spark):
    logins = feed(spark, schemas.SIGN_INS, "event_timestamp", [{"event_timestamp": T0, "user_email": "u", "is_suspicious": True, "ip_address": "i"}])
    got = feed(spark, schemas.DOWNLOADS, "event_timestamp", [{"event_timestamp": T0 + 60_000, "user": "u", "file_name": "f", "url": "x"}])
    det = lambda f, s: {"event_timestamp": T0 + 120_000, "user_email": "u", "file_name": f, "severity": s, "detection_name": "m"}
    found = feed(spark, schemas.DETECTIONS, "event_timestamp", [det("f", "CRITICAL"), det("g", "CRITICAL"), det("f", "HIGH")])
    (r,) = incidents.triage_prompt(incidents.correlated_incidents(logins, got, found)).collect()
    assert (r.downloaded_file, r.malware_name) == ("f", "m") and "country: unknown" in r.prompt


def test_flash_loan(spark):
    p, big = incidents.POOL, 2_000_000.0
    tx = lambda f, t, b, s: {"from_address": f, "to_address": t, "tx_token": "T", "tx_amount": big, "block_number": b, "event_timestamp": T0 + s}
    txs = feed(spark, schemas.ONCHAIN, "event_timestamp", [tx(p, "a", 10, 0), tx("a", p, 11, 500), tx(p, "b", 10, 0), tx("b", p, 13, 600)])
    attacks = incidents.flash_loan_attacks(txs)
    assert [(r.attacker, r.block_number) for r in attacks.collect()] == [("a", 10)]
    prices = feed(spark, schemas.DEX_PRICES, "event_timestamp", [{"event_timestamp": T0 + 1000, "price": 1850.75}, {"event_timestamp": T0 + 5000, "price": 1.0, "join_helper": "A"}])
    gas = feed(spark, schemas.MEMPOOL, "event_timestamp", [{"event_timestamp": T0, "block_number": 10, "avg_gas_price_gwei": 99}])
    shown = lambda **how: [(r.price_at_attack, r.gas_at_attack) for r in incidents.sentinel_triggers(attacks, prices, gas, **how).collect()]
    assert shown() == [(None, 99)] and shown(ignore_helper=True) == [(1850.75, 99)]
    assert "price: unknown" in incidents.risk_prompt(incidents.sentinel_triggers(attacks, prices, gas)).first().prompt


def test_premium_passengers(spark):
    flights = feed(spark, schemas.FLIGHTS, "event_timestamp", [{"flight_id": "f", "flight_status": "CANCELED", "event_timestamp": ts(3600)}, {"flight_id": "g", "flight_status": "ON_TIME", "event_timestamp": ts(0)}], "timestamp")
    bookings = feed(spark, schemas.BOOKINGS, "booking_timestamp", [{"flight_id": "f", "passenger_id": x, "booking_timestamp": ts(10)} for x in ("gold", "silver", "none")], "timestamp")
    profiles = feed(spark, schemas.PROFILES, "update_timestamp", [{"passenger_id": x, "first_name": "A", "last_name": "B", "loyalty_tier": x.upper(), "preferences": ("aisle",), "update_timestamp": ts(0)} for x in ("gold", "silver")], "timestamp")
    (r,) = incidents.disrupted_premium_passengers(flights, bookings, profiles).collect()
    assert (r.passenger_id, r.full_name, r.seating_preference) == ("gold", "A B", "aisle")


def test_suspicious_patterns(spark):
    act = lambda p, kind, seq, **x: {"player_id": p, "action_type": kind, "event_timestamp": T0, "seq": seq, **x}
    hit = lambda p, locks, headshot=True: [act(p, "AIM", 0), *[act(p, "LOCK_ON_TARGET", 1 + i, reaction_time_ms=r) for i, r in enumerate(locks)], act(p, "FIRE", 9, is_headshot=headshot)]
    rows = hit("one", [10]) + hit("two", [15, 5]) + hit("slow", [25]) + hit("pro", [10]) + hit("miss", [10], False)
    actions = feed(spark, schemas.PLAYER_ACTIONS, "event_timestamp", rows)
    history = feed(spark, schemas.PLAYER_HISTORY, "update_timestamp", [{"player_id": p, "update_timestamp": T0 - 1, "total_matches_played": 7, "historical_headshot_rate": 0.3 if p == "pro" else 0.05} for p in ("one", "two", "slow", "pro", "miss")])
    got = {r.player_id: (r.suspicious_reaction_time, r.player_matches_played) for r in signals.suspicious_patterns(actions, history).collect()}
    assert got == {"one": (10, 7), "two": (5, 7)}


def test_viewer(spark):
    seen = feed(spark, schemas.USER_INTERACTIONS, "event_ts_long", [{"event_type": "view_details", "user_id": "u", "content_id": c, "event_ts_long": T0 + i} for i, c in enumerate("aab")] + [{"event_type": "search", "user_id": "u", "event_ts_long": T0}])
    content = feed(spark, schemas.CONTENT_METADATA, "ts_long", [{"content_id": c, "genres": f"g{c}", "ts_long": T0 - 1} for c in "ab"])
    got = viewer.indecisive_viewers(viewer.viewer_interest(seen, content)).collect()
    assert len(got) == 5 and {(r.genres_list, r.weighted_interest_score_sum_list, r.abandoned_views_in_window) for r in got} == {("ga,gb", "6,3", 3)}
    played = feed(spark, schemas.USER_INTERACTIONS, "event_ts_long", [{"event_type": k, "user_id": "u", "content_id": "a", "event_ts_long": T0} for k in ("view_details", "view_details", "view_details", "play")])
    assert viewer.indecisive_viewers(viewer.viewer_interest(played, content)).count() == 5
    assert viewer.indecisive_viewers(viewer.viewer_interest(played, content, include_play=True)).count() == 0


def test_vitals(spark):
    rows = [{"patient_id": "p", "event_timestamp": ts(60 * i), "heart_rate_bpm": 60 + 10 * i, "respiratory_rate_rpm": 12} for i in range(3)] + [{"patient_id": "q", "event_timestamp": ts(0), "heart_rate_bpm": 60}]
    got = {r.patient_id: (r.avg_hr_15m, r.stddev_hr_15m) for r in signals.vital_features(feed(spark, schemas.VITALS, "event_timestamp", rows, "timestamp")).collect()}
    assert got == {"p": (70.0, 10.0), "q": (60.0, None)}


def test_next_best_action(spark):
    page = lambda u, i, p: {"user_id": u, "page": p, "event_timestamp": ts(i)}
    pages = [page(u, i, f"/{i}") for u in ("stuck", "both") for i in range(5)] + [page(u, 9, "/checkout") for u in ("pay", "both", "chatty")] + [page("none", 0, "/a")]
    pages = feed(spark, schemas.PAGE_VIEWS, "event_timestamp", pages, "timestamp")
    carts = feed(spark, schemas.CART_UPDATES, "event_timestamp", [{"user_id": "pay", "cart_action": "ADD", "event_timestamp": ts(1)}], "timestamp")
    chats = feed(spark, schemas.CHATS, "event_timestamp", [{"user_id": "chatty", "message": "hi", "event_timestamp": ts(1)}], "timestamp")
    got = {r.user_id: r.action for r in signals.next_best_action(signals.shopper_context(pages, carts, chats)).collect()}
    assert got == {"stuck": "chat", "both": "chat", "pay": "discount", "chatty": "none", "none": "none"}


def test_cloud_logs(spark):
    import json

    audit = {"time": "2024-01-01T00:00:00.000Z", "type": "com.oraclecloud.x", "oracle": {"compartmentid": "c"}, "data": {"eventGroupingId": "g/h", "request": {"id": "r/trace/span", "headers": {"opc-request-id": ["o"]}, "action": "POST"}, "response": {"status": "404"}}, "unknown": 1}
    bare = {**audit, "data": {"eventGroupingId": "g/h", "request": {"id": "x"}}}
    lines = spark.createDataFrame([(json.dumps(x),) for x in (audit, bare, {**audit, "type": "other"})], "v string")
    rows = cloudlogs.normalize_audit(lines.select(F.from_json("v", schemas.AUDIT_RAW).alias("r")).select("r.*"))
    a, b = sorted(rows.collect(), key=lambda r: r.opcrequestid is None)
    assert len(rows.columns) == 23
    assert (a.opcrequestid, a.traceid, a.spanid, a.best_request_correlation, a.besttraceid, a.responsestatus) == ("o", "trace", "span", "o", "trace", "404")
    assert (b.opcrequestid, b.traceid, b.best_request_correlation, b.eventtraceid) == (None, None, "h", "h")
    one = cloudlogs.normalize_audit(lines.select(F.from_json("v", schemas.AUDIT_RAW).alias("r")).select("r.*"), split_base=1).where("opcrequestid = 'o'").first()
    assert (one.traceid, one.spanid) == ("r", "trace")
    log = lambda m: {"time": "2024-01-01T00:00:00.000Z", "type": cloudlogs.INVOKED, "data": {"message": m, "requestId": "q/trace"}}
    logs = spark.createDataFrame([(json.dumps(log(m)),) for m in ("Processing error", "plain", None)], "v string").select(F.from_json("v", schemas.FUNCTION_LOG_RAW).alias("r")).select("r.*")
    flat = cloudlogs.normalize_function_logs(logs)
    assert len(flat.columns) == 18 and {(r.message, r.lifecycle_phase, r.besttraceid) for r in flat.collect()} == {("Processing error", "Processing", "trace"), ("plain", None, "trace")}
    assert cloudlogs.trace_errors_to_actions(flat, rows).count() == 1
    assert cloudlogs.failed_requests(rows).count() == 1 and cloudlogs.write_actions(rows).count() == 1 and cloudlogs.error_logs(flat).count() == 1
