"""Work that must not grow faster than its input."""

import random
import re
from datetime import datetime, timedelta
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from streamctx.operators import joins, patterns
from streamctx.operators.joins import correlate
from streamctx.streaming import stateful
from streamctx.streaming.replay import replay, write_in_order

T0 = datetime(2024, 1, 1)
at = lambda s: T0 + timedelta(seconds=s)


class Counted:
    """State in memory that counts its calls."""

    def __init__(self):
        self.calls = 0

    def _box(self, held, **named):
        def counted(f):
            def call(*a):
                self.calls += 1
                return f(*a)

            return call

        return SimpleNamespace(**{n: counted(f) for n, f in named.items()})

    def getValueState(self, name, schema):
        held = {}
        return self._box(held, exists=lambda: "v" in held, get=lambda: held["v"], update=lambda v: held.__setitem__("v", v), clear=lambda: held.pop("v", None))

    def getMapState(self, name, key, value):
        held = {}
        return self._box(held, getValue=held.__getitem__, updateValue=held.__setitem__, removeKey=held.pop, containsKey=held.__contains__)

    def registerTimer(self, ms):
        self.calls += 1

    deleteTimer = registerTimer


def test_keys_of_a_bucket_share_calls_of_state(monkeypatch):
    monkeypatch.setattr(stateful, "CELL_KEYS", 50)
    op, handle, r = stateful._AsOf([[], []]), Counted(), random.Random(1)
    op.init(handle)
    rows, want, current = [], {}, {}
    for t in range(20_000):
        key, side = str(r.randrange(3000)), r.random() < 0.5
        rows.append((t * 10**6, int(side), 0, "", str(t), key))
        if side:
            want[str(t)] = [current.get(key)]
        else:
            current[key] = str(t)
    got = {}
    for batch in range(4):
        part = rows[batch * 5000 : (batch + 1) * 5000]
        r.shuffle(part)
        frame = pd.DataFrame(part, columns=["t", "side", "feed", "tie", "row", "key"])
        list(op.handleInputRows(None, iter([frame]), None))
        mark = (batch + 1) * 5000 * 1000 - (0 if batch == 3 else 700_000)
        for out in op.handleExpiredTimer(None, SimpleNamespace(getCurrentWatermarkInMs=lambda mark=mark: mark), None):
            got |= dict(zip(out["fact"], out["versions"], strict=True))
    assert got == want
    assert handle.calls < 2_000


def test_a_large_micro_batch_is_several_files_and_stays_one_micro_batch(spark, tmp_path, monkeypatch):
    from streamctx.streaming import replay

    monkeypatch.setattr(replay, "FILE_ROWS", 100)
    table = spark.range(3000).select("id", F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("t"))
    files = write_in_order(table, str(tmp_path / "in"), "t", 5)
    read = spark.read.parquet(str(tmp_path / "in"))
    assert files > 1 and read.count() == 3000 and len(read.inputFiles()) == 5 * files


def test_risk_is_counted_without_making_pairs(spark):
    """40 logins, flows and alerts of one address within each other's reach: 64,000 pairs are counted, and no join is in the plan."""
    from streamctx.plans import soc

    r = random.Random(4)
    auth = [(at(r.randrange(60)), f"u{i % 3}", r.choice(["a", "b", None]), "x", "x", r.choice(["FAIL", "OK", None]), r.choice([True, False, None])) for i in range(40)]
    auth += auth[:3]
    flows = [(at(r.randrange(90)), r.choice(["a", "b"]), "d", 1, "p", r.choice([None, 10**7, 5])) for _ in range(40)]
    alerts = [(at(r.randrange(90)), "a", r.choice(["s", None]), r.choice(["HIGH", "LOW"])) for _ in range(40)]
    feeds = (
        spark.createDataFrame(auth, "event_time timestamp, user_id string, src_ip string, location string, device_id string, outcome string, mfa_used boolean"),
        spark.createDataFrame(flows, "event_time timestamp, src_ip string, dest_ip string, dest_port int, protocol string, bytes_sent bigint"),
        spark.createDataFrame(alerts, "event_time timestamp, src_ip string, signature string, severity string"),
    )
    got = soc.security_risk_context(*feeds, within="30 seconds")
    want = soc.risk_windows(soc.security_events(*feeds, within="30 seconds", bucketed=True))
    shown = lambda df: sorted(map(tuple, df.select(*want.columns).collect()), key=str)
    assert shown(got) == shown(want) and len(shown(got)) > 20
    assert "Join" not in got._jdf.queryExecution().analyzed().toString()
    late = soc.recent_security_events(*feeds, "20 seconds", within="30 seconds")
    every = soc.recent_correlated_events(soc.security_events(*feeds, within="30 seconds", bucketed=True), "20 seconds")
    assert sorted(map(tuple, late.collect()), key=str) == sorted(map(tuple, every.collect()), key=str) and every.count() > 10


def test_loans_meet_only_payments_of_near_blocks(spark):
    """One borrower's 20,000 loans and payments of a day: 4e8 pairs by address and day, 20,000 by blocks too."""
    from streamctx.plans import incidents

    ids = spark.range(40_000)
    pool = F.col("id") % 2 == 0
    txs = ids.select(F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("event_time"), F.when(pool, "pool").otherwise("u").alias("from_address"), F.when(pool, "u").otherwise("pool").alias("to_address"), F.lit("T").alias("tx_token"), F.lit(20.0).alias("tx_amount"), (F.col("id") - 50).alias("block_number"))
    out = incidents.flash_loan_attacks(txs, "pool", 10, 2, "24 hours")
    assert "blocks#" in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 20_000 and out.select("block_number").distinct().count() == 20_000


def test_runs_of_symbols_share_a_call_of_python(spark):
    from streamctx.operators import patterns

    r = random.Random(6)
    rows = [(p, i, r.choice("ALLFX")) for p in range(50) for i in range(200)]
    df = spark.createDataFrame(rows, "p long, i long, s string")
    out = patterns.match_sequence(df, by=["p"], order=["i"], defines={s: F.col("s") == s for s in "ALF"}, pattern="A L+ F", measures=lambda part, text: {"last": int(part["i"].iloc[-1]), "n": len(text)}, out_schema="p long, last long, n long")
    want = []
    for p in range(50):
        text = "".join(s for q, _, s in rows if q == p)
        want += [(p, m.end() - 1, m.end() - m.start()) for m in re.finditer("AL+F", text)]
    assert sorted(map(tuple, out.collect())) == sorted(want) and len(want) > 100
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().analyzed().toString()


def test_a_log_row_meets_lists_of_audit_rows_on_streams(spark, tmp_path):
    """Audit rows of a key and bucket are one entry of state; a list that ends long after a log row, in a later micro-batch, still reaches it."""
    hours = lambda h: f"timestamp_seconds(cast({h} * 3600 as bigint) + 1704067200)"
    rows = spark.range(400).select("id", F.expr(hours("id * 0.3")).alias("ts"), F.expr("id % 2 = 0").alias("log"), F.expr("CASE WHEN id % 3 > 0 THEN 'a' ELSE concat('b', id) END").alias("a"), F.expr("CASE WHEN id % 5 > 0 THEN 'hot' END").alias("b"))
    rows = rows.unionByName(spark.createDataFrame([(-1, True, "x", "x"), (-1, False, "x", "x")], "id long, log boolean, a string, b string").withColumn("ts", F.expr(hours(5000))))

    def found(df):
        logs, audit = df.where("log").select("id", "ts", "a", "b"), df.where("NOT log").select("id", F.col("ts").alias("at"), "a", "b")
        out = correlate(audit, logs, keys=("a", "b"), audit_ts="at", log_ts="ts", within="12 hours")
        plans.append(out._jdf.queryExecution().analyzed().toString())
        return out.select("id", "audit_id", "matched_on")

    plans: list[str] = []
    got = sorted(tuple(r) for r in replay(rows, found, ts="ts").where("id >= 0").collect())
    want = sorted(tuple(r) for r in found(rows).where("id >= 0").collect())
    assert got == want and len({r[2] for r in got}) == 2
    assert plans[0].count("collect_list") and not plans[1].count("collect_list")


def test_risk_is_counted_without_making_pairs_on_streams(spark, tmp_path):
    """Of 600 logins of one address with 600 flows and 600 alerts each near them no pair is made: a login meets one list."""
    from streamctx.plans import soc

    kinds = ("auth", "flow", "alert")
    far = spark.createDataFrame([(-i, x, 900_000_000) for i, x in enumerate(kinds, 1)], "id long, kind string, ms long")
    rows = spark.range(1800).select("id", F.expr("element_at(array('auth', 'flow', 'alert'), cast(id % 3 + 1 as int))").alias("kind"), (F.col("id") * 37 % 90_000).alias("ms")).unionByName(far)
    rows = rows.withColumn("event_time", F.expr("timestamp_millis(1704067200000 + ms)"))

    def found(df, **how):
        of = lambda kind, **c: df.where(F.col("kind") == kind).select("event_time", F.when(F.col("id") < 0, "far").otherwise("ip").alias("src_ip"), *[F.expr(v).alias(n) for n, v in c.items()])
        auth = of("auth", user_id="concat('u', id % 2)", outcome="if(id % 5 = 0, 'FAIL', 'OK')", mfa_used="id % 7 = 0")
        out = soc.security_risk_context(auth, of("flow", bytes_sent="if(id % 4 > 0, id, NULL)"), of("alert", signature="if(id % 11 > 0, 's', NULL)", severity="if(id % 2 = 0, 'HIGH', 'LOW')"), within="20 seconds", **how)
        plans.append(out._jdf.queryExecution().analyzed().toString())
        return out.withColumn("window_start", F.unix_millis("window_start")).drop("window_end")

    plans: list[str] = []
    got = replay(rows, lambda s: found(s, watermark="1 second"), ts="event_time").where("src_ip <> 'far'").collect()
    want = found(rows).where("src_ip <> 'far'").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 20
    assert plans[0].count("Join ") == 1 and "collect_list" in plans[0]


def test_slices_share_calls_of_python_for_longest_matches(spark):
    """Whole slices go to Python many at a time, and a slice of more rows than a call should have stays whole."""
    import pyarrow as pa

    calls: list[list[int]] = []

    def work(table, groups):
        calls.append([b - a for a, b in groups])
        return table

    numbers = [i for size in (3, 2, 50, *[1] * 30, 4) for i in range(1, size + 1)]
    batches = [pa.record_batch([pa.array(numbers[k : k + 5], pa.int32())], ["i"]) for k in range(0, len(numbers), 5)]
    out = [x for b in patterns._of_groups(work, rows=20)(iter(batches)) for x in b.column("i").to_pylist()]
    assert out == numbers and [n for c in calls for n in c] == [3, 2, 50, *[1] * 30, 4] and len(calls) < 8
    df = spark.range(300).select((F.col("id") % 40).alias("k"), F.timestamp_seconds(F.col("id") * 7 % 1000).alias("t"), "id", F.expr("element_at(array('a', 'l', 'l', 'f'), cast(id % 4 + 1 as int))").alias("s"))
    found = patterns.match_longest(df, by=["k"], ts="t", tiebreak=["id"], defines={x.upper(): F.col("s") == x for x in "alf"}, pattern="A L* F?", time_slice="100 seconds")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan and "FlatMapCoGroups" not in plan and plan.count("MapInArrow") == 3


def _feeds(spark):
    r = random.Random(9)
    key = lambda: r.choice(["a", "b", None])
    some = lambda n: [(i, key(), key(), at(r.randrange(300))) for i in range(n)]
    return spark.createDataFrame(some(80), "id long, k string, k2 string, t timestamp"), spark.createDataFrame(some(90), "r long, k string, k2 string, rt timestamp")


def _condition(df):
    """The join conditions of a plan."""
    return "".join(line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line)


def _rows(df):
    return sorted(map(str, df.collect()))


def test_pairs_add_no_intervals_and_large_sides_are_dealt(spark, monkeypatch):
    """The ends of a row's interval are columns; sides that aren't small go to as many tasks as shuffles have, with the same rows."""
    left, right = (df.drop("k2") for df in _feeds(spark))
    for how in ("inner", "left", "right", "full", "semi", "anti"):
        join = lambda how=how, **kw: joins.interval_join(left, right, on=["k"], left_ts="t", right_ts="rt", within="30 seconds", how=how, **kw)
        monkeypatch.setattr(joins, "SMALL_BYTES", 1 << 200)
        small, plain = join(), join(bucketed=False)
        assert "INTERVAL" not in _condition(small) and "REPARTITION_BY_NUM" not in small._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(joins, "SMALL_BYTES", 0)
        dealt = join()
        monkeypatch.undo()
        assert "REPARTITION_BY_NUM" in dealt._jdf.queryExecution().executedPlan().toString()
        assert _rows(dealt) == _rows(small) == _rows(plain) and dealt.columns == small.columns


def test_the_second_join_of_security_events_shuffles_no_pairs(spark):
    """Three feeds, three shuffles; before, pairs of logins and flows were a fourth."""
    from streamctx.plans import soc

    left, right = _feeds(spark)
    auth = left.select(F.col("t").alias("event_time"), F.col("id").cast("string").alias("user_id"), F.col("k").alias("src_ip"), *[F.lit("x").alias(c) for c in ("location", "device_id", "outcome")], F.lit(True).alias("mfa_used"))
    flows = right.select(F.col("rt").alias("event_time"), F.col("k").alias("src_ip"), F.lit("x").alias("dest_ip"), F.lit(1).alias("dest_port"), F.lit("x").alias("protocol"), F.col("r").alias("bytes_sent"))
    alerts = right.select(F.col("rt").alias("event_time"), F.col("k2").alias("src_ip"), F.col("r").cast("string").alias("signature"), F.lit("LOW").alias("severity"))
    monkey = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = soc.security_events(auth, flows, alerts, within="20 seconds")
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 3
        assert _rows(got) == _rows(soc.security_events(auth, flows, alerts, within="20 seconds", bucketed=False)) and got.count() > 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", monkey)


def test_correlated_pairs_add_no_intervals_and_large_sides_are_dealt(spark, monkeypatch):
    logs, audit = _feeds(spark)
    find = lambda: correlate(audit, logs, keys=("k", "k2"), audit_ts="rt", log_ts="t", within="20 seconds")
    monkeypatch.setattr(joins, "SMALL_BYTES", 1 << 200)
    small = find()
    assert "INTERVAL" not in _condition(small) and "REPARTITION_BY_NUM" not in small._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(joins, "SMALL_BYTES", 0)
    dealt = find()
    monkeypatch.undo()
    assert dealt._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 4
    assert _rows(dealt) == _rows(small) and {r.matched_on for r in small.collect()} == {"k", "k2"} and dealt.columns == small.columns


def _through(op, rows, until, frame=1000):
    """A bucket's rows of one micro-batch, then its timer."""
    op.init(Counted())
    frames = [pd.DataFrame(rows[i : i + frame], columns=["t", "side", "feed", "tie", "row", "key"]) for i in range(0, len(rows), frame)]
    list(op.handleInputRows(None, iter(frames), None))
    outs = op.handleExpiredTimer(None, SimpleNamespace(getCurrentWatermarkInMs=lambda: until), None)
    return sorted(map(str, (tuple(r) for out in outs for r in out.itertuples(index=False))))


def test_a_bucket_of_many_rows_is_never_held_whole(monkeypatch):
    """30,000 rows of one key go through in parts, with the rows of one part; matches that an idle time ends too."""
    r = random.Random(3)
    rows = [(t * 10**6, int(r.random() < 0.5), 0, "", str(t), "k") for t in range(30_000)]
    gaps = [(t, 0, 0, "", r.choice("AALX") + str(i), r.choice("kl")) for i, t in enumerate(sorted(r.randrange(10**11) for _ in range(20_000)))]
    r.shuffle(rows)
    r.shuffle(gaps)
    sizes: list[int] = []
    step = stateful._AsOf.step
    monkeypatch.setattr(stateful._AsOf, "step", lambda self, ready, until: sizes.append(len(ready)) or step(self, ready, until))
    longest = lambda: stateful._Longest([[]], patterns.Automaton.of("A L*"), 20_000_000)
    found = []
    for held in (10**9, 1_000):
        monkeypatch.setattr(stateful, "HELD_ROWS", held)
        monkeypatch.setattr(stateful, "SLICE_ROWS", 100)
        sizes.clear()
        found.append((_through(stateful._AsOf([[], []]), rows, 10**8), _through(longest(), gaps, 10**9), max(sizes)))
    assert found[0][:2] == found[1][:2] and len(found[0][1]) > 1_000
    assert found[0][2] == 30_000 and found[1][2] < 5_000


def test_stores_of_an_executor_share_their_memory(spark):
    from streamctx.streaming.replay import stream_session

    assert stream_session(spark).conf.get("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage") == "true"


def test_viewers_on_streams_keep_no_row_for_each_window(spark):
    """Windows are read from lists of panes: 24 windows an event before, a pane and two lists now, with the rows of the batch job."""
    from streamctx.plans import viewer

    r = random.Random(8)
    rows = [(at(r.randrange(86400 * 5)), r.choice(["u", "v", "w"]), r.randrange(4), r.choice(["view_details", "view_details", "hover", "play"]), "seen") for _ in range(300)]
    rows += [(at(r.randrange(86400 * 2)), None, c, None, "content") for c in range(3) for _ in range(4)]
    rows += [(at(86400 * 100), "end", 0, kind, of) for of, kind in (("seen", "view_details"), ("content", None))]
    df = spark.createDataFrame(rows, "event_time timestamp, user_id string, content_id long, event_type string, of string")
    shown = ("user_id", "genres_list", "weighted_interest_score_sum_list", "cnt", "abandoned_views_in_window", "has_played_content_count", "w_start_ux", "llm_prompt")
    plans: list[str] = []

    def feeds(s):
        content = s.where("of = 'content'").select("event_time", "content_id", F.lit("t").alias("title"), F.expr("CASE WHEN content_id > 0 THEN concat('g', content_id) END").alias("genres"))
        return s.where("of = 'seen'").select("event_time", "user_id", "content_id", "event_type"), content

    for play in (False, True):
        how = {"include_play": play, "size": "6 hours", "slide": "1 hour"}

        def build(s, how=how):
            out = viewer.indecisive_viewers_stream(*feeds(s), min_abandoned=1, **how)
            plans.append(out._jdf.queryExecution().analyzed().toString())
            return out.select(*shown)

        got = replay(df, build, ts="event_time", batches=3).where("user_id <> 'end'")
        want = viewer.indecisive_viewers(viewer.viewer_interest(*feeds(df), **how), min_abandoned=1).where("user_id <> 'end'").select(*shown)
        assert _rows(got) == _rows(want) and want.count() > 50
    assert all("collect_list(struct(at" in p for p in plans)
