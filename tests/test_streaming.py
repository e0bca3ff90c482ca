"""Streams against the batch results, and readers and writers."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from streamctx.operators import joins, patterns, windows
from streamctx.sources import io
from streamctx.streaming import stateful

T0 = datetime(2024, 1, 1)
at = lambda s: T0 + timedelta(seconds=s)


class Replay:
    """Rows in files, one micro-batch for each file."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder

    def feed(self, name, files, schema):
        path = str(self.folder / name)
        for rows in files:
            self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        read = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        return read, self.spark.createDataFrame([r for rows in files for r in rows], schema)

    def result(self, df, mode="append"):
        out = str(self.folder / "out")
        query = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", str(self.folder / "cp")).trigger(availableNow=True).start(out)
        query.awaitTermination()
        return self.spark.read.schema(df.schema).parquet(out)


@pytest.fixture
def replay(spark, tmp_path):
    return Replay(spark, tmp_path)


FAR = 100_000


def test_asof_stream_equals_batch(replay):
    facts = [[(1, 1, at(5)), (2, 1, at(12))], [(3, 1, at(10)), (4, 2, at(15)), (5, 1, at(25))], [(6, 1, at(20))], [(99, 9, at(FAR))], [(98, 9, at(2 * FAR))]]
    versions = [[(1, at(20), "b")], [(1, at(10), "a"), (3, at(1), "z")], [(2, at(16), "late")], [(9, at(FAR), "end")], [(9, at(2 * FAR), "end2")]]
    fs, fb = replay.feed("f", facts, "id long, k long, t timestamp")
    vs, vb = replay.feed("v", versions, "k long, vt timestamp, v string")
    got = replay.result(stateful.asof_stream(fs, vs, on=["k"], left_ts="t", right_ts="vt", watermark="60 seconds"))
    want = joins.asof_join(fb, vb, on=["k"], left_ts="t", right_ts="vt", tiebreak="v")
    rows = lambda df: sorted(((r.id, r.k, r.t, r.vt, r.v) for r in df.where("id < 90").collect()), key=str)
    assert rows(got) == rows(want) and len(rows(got)) == 6


def test_asof_stream_with_ties_null_keys_and_null_times(replay):
    day = at(10).date()
    facts = [[(1, None, at(15)), (2, 1, at(15)), (3, 1, None)], [(4, 1, at(30)), (5, 2, at(30))], [(99, 9, at(FAR))], [(98, 9, at(2 * FAR))]]
    versions = [[(None, at(10), 5, b"x", day), (1, at(10), 9, b"y", day), (1, at(10), 10, b"z", None)], [(1, at(20), -3, None, day), (1, at(20), None, b"w", day), (1, None, 4, b"n", day), (2, at(20), None, b"a", None), (2, at(20), None, b"b", None)], [(9, at(FAR), 1, b"e", day)], [(9, at(2 * FAR), 1, b"e", day)]]
    fs, fb = replay.feed("f", facts, "id long, k long, t timestamp")
    vs, vb = replay.feed("v", versions, "k long, vt timestamp, v long, b binary, d date")
    got = replay.result(stateful.asof_stream(fs, vs, on=["k"], left_ts="t", right_ts="vt", tiebreak="v", watermark="60 seconds"))
    want = joins.asof_join(fb, vb, on=["k"], left_ts="t", right_ts="vt", tiebreak="v")
    rows = lambda df: sorted(((r.id, r.k, r.t, r.vt, r.v, r.b and bytes(r.b), r.d) for r in df.where("id < 90").collect()), key=str)
    assert rows(got) == rows(want)
    assert [(r[0], r[4]) for r in rows(got)] == [(1, None), (2, 10), (3, None), (4, -3), (5, None)]


def test_changelog_stream_equals_batch(replay):
    files = [[("a", 1000, 1), ("a", 1000, 2), (None, 1000, 3)], [("a", 2000, 4), ("b", 1000, 5)], [("z", FAR * 1000, 0)], [("z", 2 * FAR * 1000, 0)]]
    s, b = replay.feed("c", files, "k string, ts long, v int")
    feed = lambda df: io.versions(io.with_event_time(df, "ts"), ["k"], "ts", watermark="10 seconds")
    rows = lambda df: sorted(map(tuple, df.where("k <> 'z'").collect()))
    assert rows(replay.result(feed(s))) == rows(feed(b)) and len(rows(feed(b))) == 3


def test_view_of_changes_is_made_whole_from_time_to_time(spark, tmp_path):
    path, schema, want = str(tmp_path / "view"), "k string, t long, v int", {}
    for n in range(9):
        rows = [(f"k{(n * 7 + i) % 5}", n - i % 3, n * 10 + i) for i in range(4)]
        for k, t, v in rows:
            want[k] = max(want.get(k, (t, v)), (t, v))
        io.materialize(spark.createDataFrame(rows, schema), path, keys=["k"], version_col="t", changes=2)
        assert {r.k: (r.t, r.v) for r in io.read_view(spark, path).collect()} == want
        state = io._state(spark, path)
        assert len(state.changes) <= 2
    assert len(io._numbers(spark, path)) <= 9 and len(io._names(spark, f"{path}/data")) <= 9


def test_batch_and_stream_writers_of_one_view_lose_nothing(replay, spark, tmp_path):
    """Writers take turns on one view; a stream's batch that is run again changes nothing."""
    path, schema, want = str(tmp_path / "view"), "k string, t long, v int", {}
    files = [[(f"k{n}", 50 + n, n), ("shared", n, n)] for n in range(6)]
    s, _ = replay.feed("c", files, schema)

    def note(rows):
        for k, t, v in rows:
            want[k] = max(want.get(k, (t, v)), (t, v))

    from streamctx.sources.io import _upsert

    def both(batch, n):
        """The stream's batch, another writer's batch between, and the stream's batch again."""
        _upsert(batch, path, ["k"], "t", 3, 4, "stream", n)
        mine = [("new", 90 + n, n), ("shared", 100 - n, n), (f"b{n}", 1, n)]
        note(mine)
        io.materialize(batch.sparkSession.createDataFrame(mine, schema), path, keys=["k"], version_col="t", changes=3, buckets=4)
        before = io._state(batch.sparkSession, path).number
        _upsert(batch, path, ["k"], "t", 3, 4, "stream", n)
        assert io._state(batch.sparkSession, path).number == before
        note([tuple(r) for r in batch.collect()])
        assert {r.k: (r.t, r.v) for r in io.read_view(batch.sparkSession, path).collect()} == want

    s.writeStream.foreachBatch(both).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert len(want) == 14 and {r.k: (r.t, r.v) for r in io.read_view(spark, path).collect()} == want


def test_two_writers_cannot_take_one_number(spark, tmp_path):
    path = str(tmp_path / "view")
    io.materialize(spark.createDataFrame([("a", 1)], "k string, t long"), path, keys=["k"], version_col="t")
    assert io._commit(spark, path, 1, {}) is False
    assert io._numbers(spark, path) == [1] and [n for n in io._names(spark, f"{path}/_log") if not n.endswith((".json", ".crc"))] == []


def test_lookups_read_one_bucket_and_unchanged_buckets_stay(spark, tmp_path):
    path, schema = str(tmp_path / "view"), "k string, t long, v int"
    io.materialize(spark.createDataFrame([(f"k{i}", 1, i) for i in range(200)], schema), path, keys=["k"], version_col="t", buckets=8)
    io.compact_view(spark, path)
    first = io._state(spark, path).whole["parts"]
    io.materialize(spark.createDataFrame([("k7", 2, 700)], schema), path, keys=["k"], version_col="t")
    found = io.lookup_view(spark, path, k="k7")
    assert [tuple(r) for r in found.collect()] == [("k7", 2, 700)]
    assert 1 <= len({f.rpartition("/_bucket=")[2].partition("/")[0] for f in found.inputFiles()}) == 1 and len(found.inputFiles()) < len(io.read_view(spark, path).inputFiles()) / 3
    assert "PushedFilters: [EqualNullSafe(k,k7)]" in found._jdf.queryExecution().executedPlan().toString()
    io.compact_view(spark, path)
    second = io._state(spark, path).whole["parts"]
    assert len(first) == 8 and [b for b in first if first[b] != second[b]] == [found.inputFiles()[0].rpartition("/_bucket=")[2].partition("/")[0]]
    assert io.lookup_view(spark, path, k="none").count() == 0
    with pytest.raises(ValueError):
        io.lookup_view(spark, path, v=1)
    io.materialize(spark.createDataFrame([], schema), path, keys=["k"], version_col="t")
    assert io.read_view(spark, path).count() == 200


def test_match_stream_equals_batch(replay):
    files = [[(1, at(1), 1, "A", 1)], [(1, at(1), 2, "L", 7), (1, at(2), 3, "L", 5), (2, at(1), 1, "L", 1)], [(1, at(3), 4, "F", 0), (2, at(2), 2, "F", 0), (1, at(4), 5, "A", 0), (1, at(5), 6, "X", 0), (1, at(6), 7, "F", 0)], [(9, at(FAR), 1, "X", 0)], [(9, at(2 * FAR), 1, "X", 0)]]
    s, b = replay.feed("a", files, "p long, t timestamp, seq long, s string, v long")
    is_ = lambda c: F.col("s") == c
    symbols = {"a": is_("A"), "l": is_("L"), "f": is_("F")}
    got = replay.result(stateful.match_stream(s, by=["p"], ts="t", tiebreak="seq", **symbols, measures=lambda last, f: [f["p"].alias("p"), f["seq"].alias("seq"), last["v"].alias("v")], watermark="60 seconds"))
    want = patterns.match_a_lplus_f(b, by=["p"], order=["t", "seq"], **symbols, measures={"seq": F.col("seq"), "v": ("last_l", F.col("v"))})
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) == [(1, 4, 5)]


def test_interval_join_streams(replay):
    left, right = [[(1, 1, at(0))], [(2, 1, at(100))], [(3, 5, at(FAR))], [(4, 5, at(2 * FAR))]], [[(1, 1, at(20))], [(2, 1, at(300))], [(3, 5, at(FAR))], [(4, 5, at(2 * FAR))]]
    ls, lb = replay.feed("l", left, "id long, k long, t timestamp")
    rs, rb = replay.feed("r", right, "rid long, k long, rt timestamp")
    join = lambda a, b: joins.interval_join(a, b, on=["k"], left_ts="t", right_ts="rt", within="30 seconds", how="left")
    got = replay.result(join(ls.withWatermark("t", "10 seconds"), rs.withWatermark("rt", "10 seconds")).select("id", "rid"))
    want = join(lb, rb).select("id", "rid")
    rows = lambda df: sorted((tuple(r) for r in df.where("id < 3").collect()), key=str)
    assert rows(got) == rows(want) == [(1, 1), (2, None)]


def test_windows_drop_late_rows(replay):
    files = [[(1, at(10)), (1, at(70))], [(1, at(500))], [(1, at(20))], [(1, at(FAR))], [(1, at(2 * FAR))]]
    s, b = replay.feed("e", files, "k long, event_time timestamp")
    agg = lambda df: windows.hop_agg(df, ["k"], "1 minute", "30 seconds", {"n": ("count", F.lit(1))}, watermark="10 seconds")
    rows = lambda df: {(r.window_start, r.n) for r in df.where(F.col("window_end") < F.lit(at(1000))).collect()}
    on_time = b.where(F.col("event_time") != F.lit(at(20)))
    assert rows(replay.result(agg(s))) == rows(agg(on_time)) != rows(agg(b))


def test_distinct_counts_on_a_stream(replay):
    from streamctx.plans.aml import recent_txn_stats

    schema = "customer_id string, amount decimal(18,2), country_code string, event_time timestamp"
    from decimal import Decimal

    files = [[("c", Decimal(1), "A", at(1)), ("c", Decimal(20000), "B", at(2))], [("c", Decimal(1), "A", at(3))], [("z", Decimal(1), "A", at(FAR))], [("z", Decimal(1), "A", at(2 * FAR))]]
    s, b = replay.feed("t", files, schema)
    got = replay.result(recent_txn_stats(s.withWatermark("event_time", "1 second")))
    rows = lambda df: [tuple(r) for r in df.where("customer_id = 'c'").collect()]
    assert rows(got) == rows(recent_txn_stats(b)) and rows(got)[0][5] == 2


def test_views_and_appends(replay, spark, tmp_path):
    schema = "k string, t long, v int"
    s, b = replay.feed("c", [[("a", 1, 1), ("b", 1, 2)], [("a", 3, 3), ("b", 0, 9)]], schema)
    path = str(tmp_path / "view")
    io.materialize(s, path, keys=["k"], version_col="t", checkpoint=str(tmp_path / "cp1")).awaitTermination()
    assert sorted(map(tuple, io.read_view(spark, path).collect())) == [("a", 3, 3), ("b", 1, 2)]
    io.materialize(spark.createDataFrame([("a", 2, 7), ("d", 1, 1)], schema), path, keys=["k"], version_col="t")
    assert sorted(map(tuple, io.read_view(spark, path).collect())) == [("a", 3, 3), ("b", 1, 2), ("d", 1, 1)]
    log = str(tmp_path / "log")
    io.write_append(s, log, checkpoint=str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(log).count() == 4
    batch = str(tmp_path / "batch")
    for _ in range(2):
        io.materialize(b, batch)
    assert spark.read.parquet(batch).count() == 8
    with pytest.raises(FileNotFoundError):
        io.read_view(spark, str(tmp_path / "none"))
    latest = stateful.latest_stream(s, ["k"], ["t"]).writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start()
    latest.awaitTermination()
    assert sorted(map(tuple, spark.table("latest").collect())) == [("a", 3, 3), ("b", 1, 2)]
    assert sorted((r.k, r.now_v) for r in stateful.snapshot_join(b.select("k").distinct(), io.read_view(spark, path), on=["k"], prefix="now_").collect()) == [("a", 3), ("b", 2)]


def test_readers(spark, tmp_path):
    rows = [{"k": "a", "ts": 1000, "r": {"x": 1}, "more": 5}, {"k": "a", "ts": 1000, "r": {"x": 2}}, {"k": None, "ts": 1}, {"k": "b"}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f.json").write_text("\n".join(map(json.dumps, rows)))
    path, schema = str(tmp_path / "in"), "k string, ts long, r string"
    events = io.read_events(spark, path, schema, time_col="ts")
    assert events.count() == 4 and {r.r for r in events.collect()} == {'{"x": 1}', '{"x": 2}', None}
    assert events.where("k = 'a'").first().event_time == datetime(1970, 1, 1, 0, 0, 1)
    log = io.read_changelog(spark, path, schema, keys=["k"], version_col="ts")
    assert sorted(((r.k, r.r) for r in log.collect()), key=str) == [("a", '{"x": 2}'), ("b", None)]
    assert io.rekey(log, ["k"], "ts").count() == 1
    assert io.from_broker(spark.createDataFrame([(b'{"k": "z", "ts": 5}',)], "value binary"), schema, time_col="ts").first().k == "z"
    assert json.loads(io.to_broker(log.where("k = 'a'"), "k").first().value)["k"] == "a"
    with pytest.raises(ValueError):
        io.with_event_time(log, "ts", "days")
    options = io.broker_options("h:9092", "t", sasl={"mechanism": "SCRAM-SHA-512", "username": "u", "password": 'p"w'})
    assert options["startingOffsets"] == "earliest" and 'password="p\\"w"' in options["kafka.sasl.jaas.config"] and "ScramLoginModule" in options["kafka.sasl.jaas.config"]
    assert "PlainLoginModule" in io.broker_options("h", "t", sasl={"mechanism": "PLAIN", "username": "u", "password": "p"})["kafka.sasl.jaas.config"]


def test_descriptions(spark):
    spark.sql("CREATE OR REPLACE TEMP VIEW nothing AS SELECT 1 AS x")
    spark.sql("DROP TABLE IF EXISTS described")
    spark.range(1).write.mode("overwrite").saveAsTable("described")
    try:
        io.describe_view(spark, "described", "who's \\ it")
        rows = {r.col_name: r.data_type for r in spark.sql("DESCRIBE TABLE EXTENDED described").collect()}
        assert rows["Comment"] == "who's \\ it"
    finally:
        spark.sql("DROP TABLE described")


def test_a_silent_feed_with_heartbeats(replay, spark):
    """With the `min` policy a silent change feed holds facts back; with heartbeats none waits and no version is lost."""
    from streamctx.streaming.idle import with_heartbeats

    facts = [[(1, 1, at(5))], [(2, 1, at(300)), (3, None, at(310))], [(4, 5, at(FAR))], [(5, 5, at(2 * FAR))]]
    fs, fb = replay.feed("f", facts, "id long, k long, t timestamp")
    vs, vb = replay.feed("v", [[(1, at(0), "a"), (1, at(200), "b")]], "k long, vt timestamp, v string")
    beats, _ = replay.feed("b", [[(at(10),)], [(at(400),)], [(at(FAR),)], [(at(2 * FAR),)]], "vt timestamp")
    silent = stateful.asof_stream(fs, vs, on=["k"], left_ts="t", right_ts="vt", watermark="60 seconds")
    with_beats = stateful.asof_stream(fs.withWatermark("t", "60 seconds"), with_heartbeats(vs, "vt", "60 seconds", beats), on=["k"], left_ts="t", right_ts="vt", watermark=None)
    held = {r.id for r in replay.result(silent).collect()}
    other = Replay(spark, replay.folder / "second")
    got = sorted((r.id, r.v) for r in other.result(with_beats).collect() if r.id < 4)
    assert got == [(1, "a"), (2, "b"), (3, None)] and not {2, 4} & held


def test_an_idle_input_with_the_max_policy(replay, spark):
    """`max` lets the busy feed alone move the watermark; rows of the slow one behind it are dropped."""
    from streamctx.streaming.replay import stream_session

    replay.spark = stream_session(spark, "max")
    ls, _ = replay.feed("l", [[(1, 1, at(0)), (2, 1, at(50))], [(3, 5, at(FAR))], [(4, 5, at(2 * FAR))], [(5, 5, at(3 * FAR))]], "id long, k long, t timestamp")
    rs, _ = replay.feed("r", [[(1, 1, at(10))]], "rid long, k long, rt timestamp")
    join = joins.interval_join(ls.withWatermark("t", "10 seconds"), rs.withWatermark("rt", "10 seconds"), on=["k"], left_ts="t", right_ts="rt", within="30 seconds", how="left")
    got = sorted((r.id, r.rid) for r in replay.result(join.select("id", "rid")).collect() if r.id < 4)
    assert got == [(1, 1), (2, None), (3, None)]


def test_correlation_of_two_streams_with_a_fallback_key(replay):
    logs = [[(1, "a", "x", at(0)), (2, "b", "x", at(5)), (3, None, "y", at(6)), (4, None, None, at(7))], [(5, "a", "z", at(40)), (6, "c", "y", at(41))], [(7, "far", "far", at(FAR))], [(8, "far", "far", at(2 * FAR))]]
    audit = [[("p", "a", "z", at(1)), ("q", None, "x", at(3))], [("r", "q", "y", at(30)), ("s", "a", "z", at(45)), ("t", "a", None, at(46))], [("u", "far", "far", at(FAR))], [("w", "far", "far", at(2 * FAR))]]
    ls, lb = replay.feed("l", logs, "id long, opcrequestid string, besttraceid string, t timestamp")
    as_, ab = replay.feed("a", audit, "a string, opcrequestid string, besttraceid string, at timestamp")
    join = lambda a, b: joins.correlate(a, b, audit_ts="at", log_ts="t", within="25 seconds").select("id", "matched_on", "audit_a")
    rows = lambda df: sorted(tuple(r) for r in df.where("id < 7").collect())
    want = [(1, "opcrequestid", "p"), (2, "besttraceid", "q"), (3, "besttraceid", "r"), (5, "opcrequestid", "s"), (5, "opcrequestid", "t"), (6, "besttraceid", "r")]
    assert rows(replay.result(join(as_, ls))) == want == rows(join(ab, lb))
