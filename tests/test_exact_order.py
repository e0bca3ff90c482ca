"""One order of versions in all forms of the as-of join, kinds of interval joins, bounded timers, longest matches in slices and on streams."""

import random
import re
from datetime import datetime, timedelta
from decimal import Decimal
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from streamctx.operators import joins, patterns
from streamctx.streaming import stateful

T0 = datetime(2024, 1, 1)
at = lambda s: T0 + timedelta(seconds=s)
FAR = 10**6


def stream_of(spark, folder, files, schema):
    path = str(folder)
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def result(spark, df, folder):
    df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start(str(folder / "out")).awaitTermination()
    return spark.read.schema(df.schema).parquet(str(folder / "out"))


LONG = "x" * 45
TIES = {
    "long": ([-5, -3, None], -3),
    "int": ([9, 10, -200], 10),
    "double": ([10.5, 9.25, -1e300, None], 10.5),
    "decimal(38,4)": ([Decimal("90071992547409930.0001"), Decimal("90071992547409930.0002"), Decimal("-5")], Decimal("90071992547409930.0002")),
    "string": (["b", "aa", "", None], "b"),
    "string ": ([LONG + "a", LONG + "b", LONG], LONG + "b"),
    "binary": ([b"\x01\xff", b"\x02", b"\x01"], b"\x02"),
    "boolean": ([False, True, None], True),
    "date": ([at(0).date(), at(-86400).date(), None], at(0).date()),
    "timestamp": ([at(-10), at(-9.5), None], at(-9.5)),
    "array<int>": ([[1, 2], [1, 10], [1], None], [1, 10]),
    "struct<a: int, b: double>": ([(1, -2.5), (1, -1.5), None], (1, -1.5)),
}


@pytest.mark.parametrize("kind", TIES)
def test_ties_in_all_forms(spark, tmp_path, kind):
    values, want = TIES[kind]
    facts = spark.createDataFrame([(1, 1, at(50))], "id long, k long, t timestamp")
    schema = f"k long, vt timestamp, tie {kind.strip()}"
    for seed in range(2):
        rows = [(1, at(20), v) for v in random.Random(seed).sample(values, len(values))]
        versions = spark.createDataFrame(rows, schema)
        for how in ({}, {"time_slice": "15 seconds"}, {"broadcast": True}, {"hot_rows": 1}):
            (r,) = joins.asof_join(facts, versions, on=["k"], left_ts="t", right_ts="vt", tiebreak="tie", **how).collect()
            assert (tuple(r.tie) if isinstance(want, tuple) else bytes(r.tie) if isinstance(want, bytes) else r.tie) == want
    if kind not in ("double", "decimal(38,4)", "string ", "binary", "array<int>"):  # integers, structs and times: below and in test_streaming
        return
    fs = stream_of(spark, tmp_path / "f", [[(1, 1, at(50))], [(99, 9, at(FAR))]], "id long, k long, t timestamp")
    vs = stream_of(spark, tmp_path / "v", [rows[:1], rows[1:] + [(9, at(FAR), values[0])]], schema)
    (r,) = result(spark, stateful.asof_stream(fs, vs, on=["k"], left_ts="t", right_ts="vt", tiebreak="tie", watermark="60 seconds"), tmp_path).where("id < 90").collect()
    assert (tuple(r.tie) if isinstance(want, tuple) else bytes(r.tie) if isinstance(want, bytes) else r.tie) == want


def test_typed_keys_of_all_kinds():
    """What _texts writes and _value reads is in Spark's order; streams sort by it."""
    key = lambda v, kind: stateful._value(v, kind)
    for kind, texts in (("number", [None, "-10", "-9.5", "9", "10", "90071992547409930.0001", "90071992547409930.0002"]), ("float", [None, "-Infinity", "-2.5", "1.0E300", "Infinity", "NaN"]), ("text", [None, "", "aa", "b"]), ("bytes", [None, "", "01", "01FF", "02"])):
        assert [key(t, kind) for t in texts] == sorted(key(t, kind) for t in texts)
    rows = [None, {"a": "1", "b": None}, {"a": "1", "b": "-2.5"}, {"a": "10", "b": "-3"}]
    assert [key(x, ["number", "float"]) for x in rows] == sorted(key(x, ["number", "float"]) for x in rows)
    assert key(["1", "10"], ("number",)) > key(["1", "2"], ("number",)) > key(["1"], ("number",))


def test_nan_ties_come_last_in_all_forms(spark, tmp_path):
    facts = spark.createDataFrame([(1, 1, at(50))], "id long, k long, t timestamp")
    rows = [(1, at(20), 7.0, 1), (1, at(20), float("nan"), 2), (1, at(20), None, 3)]
    versions = spark.createDataFrame(rows, "k long, vt timestamp, tie double, n int")
    got = [joins.asof_join(facts, versions, on=["k"], left_ts="t", right_ts="vt", tiebreak="tie", **how).first().n for how in ({}, {"time_slice": "15 seconds"}, {"broadcast": True})]
    fs = stream_of(spark, tmp_path / "f", [[(1, 1, at(50))], [(99, 9, at(FAR))]], "id long, k long, t timestamp")
    vs = stream_of(spark, tmp_path / "v", [rows, [(9, at(FAR), 1.0, 0)]], "k long, vt timestamp, tie double, n int")
    out = result(spark, stateful.asof_stream(fs, vs, on=["k"], left_ts="t", right_ts="vt", tiebreak="tie", watermark="60 seconds"), tmp_path)
    assert [*got, out.where("id < 90").first().n] == [2] * 4


def test_names_do_not_clash(spark):
    helpers = "k0 long, v0 string, t timestamp, side string, slice string, fact string, _version string, _from string, _to string, _k_k0 string"
    left = spark.createDataFrame([(1, "a", at(5), *["x"] * 7)], helpers)
    right = spark.createDataFrame([(1, at(1), "r", "s")], "k0 long, vt timestamp, side string, _k_k0 string")
    for how in ({}, {"time_slice": "1 second"}, {"broadcast": True}):
        out = joins.asof_join(left, right, on=["k0"], left_ts="t", right_ts="vt", prefix="r_", **how)
        assert out.columns == [*left.columns, "r_vt", "r_side", "r__k_k0"] and out.first()["r_side"] == "r" and out.first()["side"] == "x"
    a = spark.createDataFrame([(1, at(5), "b", "n")], "k long, t timestamp, _bucket string, _near string")
    b = spark.createDataFrame([(1, at(6), "m")], "k long, rt timestamp, _k_k string")
    assert tuple(joins.interval_join(a, b, on=["k"], left_ts="t", right_ts="rt", within="5 seconds").first()) == (1, at(5), "b", "n", at(6), "m")
    logs = spark.createDataFrame([("q", "z", at(1), "h")], "opcrequestid string, besttraceid string, t timestamp, _hit string")
    audit = spark.createDataFrame([("q", "z", at(1), 1)], "opcrequestid string, besttraceid string, at timestamp, _new int")
    (r,) = joins.correlate(audit, logs, audit_ts="at", log_ts="t", within="5 seconds").collect()
    assert (r._hit, r.matched_on, r.audit__new) == ("h", "opcrequestid", 1)


@pytest.mark.parametrize("bucketed", [True, False])
@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "semi", "anti", "left_outer"])
def test_interval_kinds(spark, how, bucketed):
    r = random.Random(7)
    lrows = [(i, r.choice([1, 2, None]), at(r.randrange(200)) if i % 9 else None) for i in range(30)]
    rrows = [(i, r.choice([1, 2, 3, None]), at(r.randrange(200)) if i % 7 else None) for i in range(30)]
    pairs = [(a, b) for a in lrows for b in rrows if a[1] is not None and a[1] == b[1] and a[2] and b[2] and abs((a[2] - b[2]).total_seconds()) <= 10]
    alone_l, alone_r = [a for a in lrows if a not in [p[0] for p in pairs]], [b for b in rrows if b not in [p[1] for p in pairs]]
    inner = [(a[0], a[1], b[0]) for a, b in pairs]
    lefts, rights = [(a[0], a[1], None) for a in alone_l], [(None, b[1], b[0]) for b in alone_r]
    want = {"inner": inner, "left": inner + lefts, "left_outer": inner + lefts, "right": inner + rights, "full": inner + lefts + rights, "anti": [x[:2] for x in lefts], "semi": [a[:2] for a in lrows if a not in alone_l]}[how]
    left, right = spark.createDataFrame(lrows, "l long, k long, t timestamp"), spark.createDataFrame(rrows, "r long, k long, rt timestamp")
    got = joins.interval_join(left, right, on=["k"], left_ts="t", right_ts="rt", within="10 seconds", how=how, bucketed=bucketed)
    assert sorted((tuple(x)[:2] if how in ("semi", "anti") else (x.l, x.k, x.r) for x in got.collect()), key=str) == sorted(want, key=str)


def test_unknown_kinds_are_refused(spark):
    df = spark.createDataFrame([(1, at(1))], "k long, t timestamp")
    for join in (lambda how: joins.interval_join(df, df, on=["k"], left_ts="t", right_ts="t", within="1 second", how=how), lambda how: joins.asof_join(df, df, on=["k"], left_ts="t", right_ts="t", how=how)):
        with pytest.raises(ValueError):
            join("cross")


# --- timers


class Handle:
    """State in memory, with the number of waiting rows that are read."""

    def __init__(self):
        self.read, self.timers = 0, set()

    def getValueState(self, name, schema):
        box = SimpleNamespace(value=None)
        return SimpleNamespace(exists=lambda: box.value is not None, get=lambda: box.value, update=lambda v: setattr(box, "value", v), clear=lambda: setattr(box, "value", None))

    def getMapState(self, name, key, value):
        held = {}

        def get(k):
            self.read += len(held[k][0]) if name == "waiting" else 0
            return held[k]

        return SimpleNamespace(getValue=get, updateValue=held.__setitem__, removeKey=held.pop, containsKey=held.__contains__)

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.remove(ms)


class Emit(stateful._Ordered):
    def step(self, ready, until):
        return pd.DataFrame({"row": [r[4] for r in ready]})


@pytest.mark.parametrize("spread", ["far ahead", "shuffled"])
def test_timers_read_only_what_is_due(spread):
    """100,000 rows of one key in 20 batches: each is read once or twice, never the whole list."""
    op, handle, out, most = Emit([[]], 1_000_000), Handle(), [], 0
    op.init(handle)
    order = list(range(100_000))
    if spread == "shuffled":
        random.Random(1).shuffle(order)
    for batch in range(21):
        rows = order[batch * 5000 : (batch + 1) * 5000]
        if rows:
            frame = pd.DataFrame({"t": [t * 1000 for t in rows], "side": 0, "feed": 0, "tie": "", "row": [str(t) for t in rows]})
            list(op.handleInputRows(None, iter([frame]), None))
        # far ahead: the watermark stays 50,000 rows behind; shuffled: all wait to the end, and the watermark then moves in steps
        marks = [min(rows, default=10**6) - 50_000 if batch < 20 else 10**6] if spread == "far ahead" else ([] if batch < 20 else range(5_003, 105_000, 5_000))
        for mark in marks:
            due = [x for x in handle.timers if x <= mark]
            assert len(handle.timers) <= 1
            for x in due:
                handle.timers.remove(x)
                before = handle.read
                for frame in op.handleExpiredTimer(None, SimpleNamespace(getCurrentWatermarkInMs=lambda mark=mark: mark), None):
                    out += frame["row"].tolist()
                most = max(most, handle.read - before if mark < 10**5 or spread == "shuffled" else 0)
    assert out == [str(t) for t in range(100_000)]
    assert 0 < most <= 7_000 and handle.read <= 130_000
    assert not handle.timers and not op.index.exists()


# --- longest matches


def plain_longest(text, pattern):
    """(start, end) of the longest match from each place, by trying all ends."""
    compiled = re.compile("".join(pattern.split()))
    return [(i, max(ends)) for i in range(len(text)) if (ends := [j for j in range(i, len(text)) if compiled.fullmatch(text, i, j + 1)])]


def test_automaton_against_regular_expressions():
    r = random.Random(2)
    for pattern in ("A L+ F", "A L* F?", "A+ B* A? B", "L+", "A B? B A*", "A? B", "A* B* L"):
        automaton = patterns.Automaton.of(pattern)
        for _ in range(40):
            text = "".join(r.choice("AABLLF_") for _ in range(r.randrange(25)))
            got = automaton.ends(text, [None] * len(automaton.steps))
            assert [(i, e) for i, e in enumerate(got) if e is not None] == plain_longest(text, pattern)
    for bad in ("", "A |B", "(A B)+", "A{2}"):
        with pytest.raises(ValueError):
            patterns.Automaton.of(bad)


def symbols():
    return {s: F.col("s") == s for s in "ALF"}


@pytest.mark.parametrize("pattern", ["A L* F?", "L+ F", "A L+ F"])
def test_longest_matches_over_slices(spark, pattern):
    r = random.Random(3)
    texts = {p: "".join(r.choice("ALLLLFX") for _ in range(60)) for p in (1, 2)} | {3: "A" + "L" * 58 + "F", None: "ALF"}
    rows = [(p, at(i // 2) if i % 31 else None, i, s) for p, text in texts.items() for i, s in enumerate(text)]
    df = spark.createDataFrame(rows, "p long, t timestamp, seq long, s string")
    want = []
    for p in texts:
        own = sorted((x for x in rows if x[0] == p), key=lambda x: (x[1] is not None, x[1] or T0, x[2]))
        want += [(p, own[i][2], own[e][2], e - i + 1) for i, e in plain_longest("".join(x[3] for x in own), pattern)]
    for size in ("3 seconds", "7 seconds", "1 day"):
        got = patterns.match_longest(df, by=["p"], ts="t", tiebreak=["seq"], defines=symbols(), pattern=pattern, time_slice=size).collect()
        assert sorted(((x.p, x["first"].seq, x["last"].seq, x.rows) for x in got), key=str) == sorted(want, key=str)
    assert patterns.match_longest(df.where("false"), by=["p"], ts="t", tiebreak=["seq"], defines=symbols(), pattern=pattern).count() == 0


def test_one_run_of_a_million_rows_is_many_tasks(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit(1).alias("p"), F.timestamp_seconds("id").alias("t"), F.col("id").alias("seq"), F.when(F.col("id") == 0, "A").when(F.col("id") == n - 1, "F").otherwise("L").alias("s"))
    out = patterns.match_longest(df, by=["p"], ts="t", tiebreak=["seq"], defines=symbols(), pattern="A L* F?", time_slice="50000 seconds")
    (r,) = out.collect()
    assert (r["first"].seq, r["last"].seq, r.rows) == (0, n - 1, n)


def test_longest_matches_on_a_stream_equal_the_batch(spark, tmp_path):
    r = random.Random(5)
    rows = [(p, at(i), i, r.choice("ALLLFX")) for p in (1, 2, 3) for i in range(80)]
    schema = "p long, t timestamp, seq long, s string"
    files = [[x for x in rows if x[2] // 20 == n] for n in range(4)] + [[(9, at(FAR), 0, "X")], [(9, at(2 * FAR), 0, "X")]]
    for pattern in ("A L* F?", "L+ F"):
        folder = tmp_path / pattern[0]
        s = stream_of(spark, folder / "in", files, schema)
        got = result(spark, stateful.match_longest_stream(s, by=["p"], ts="t", tiebreak=["seq"], defines=symbols(), pattern=pattern, idle="1 hour"), folder)
        want = patterns.match_longest(spark.createDataFrame(rows, schema), by=["p"], ts="t", tiebreak=["seq"], defines=symbols(), pattern=pattern)
        shown = lambda df: sorted((x.p, x["first"].seq, x["last"].seq, x.rows, x["first"].t) for x in df.collect())
        assert shown(got) == shown(want) and len(shown(want)) > 10


def test_hot_keys_are_cut_at_quantiles_and_the_others_stay_whole(spark):
    r = random.Random(8)
    facts = [(i, 1 if i % 3 else r.randrange(2, 40), at(r.randrange(4) if i % 2 else r.randrange(10**6))) for i in range(3000)] + [(9000, None, at(1)), (9001, 1, None)]
    versions = [(1 if r.random() < 0.5 else r.randrange(2, 40), at(r.randrange(10**6)), n) for n in range(1500)] + [(None, at(1), -1), (1, None, -2)]
    left = spark.createDataFrame(facts, "id long, k long, t timestamp")
    right = spark.createDataFrame(versions, "k long, vt timestamp, n long")
    both = left.select("k", "t").union(right.select("k", "vt")).where("k IS NOT NULL AND t IS NOT NULL")
    (hot,) = joins.hot_slices(both, ["k"], "t", 200).collect()
    assert hot.k == 1 and 5 < len(hot.cuts) < 15 and hot.cuts == sorted(set(hot.cuts))
    assert joins.hot_slices(both, ["k"], "t", 10**6) is None
    join = lambda **how: sorted(joins.asof_join(left, right, on=["k"], left_ts="t", right_ts="vt", tiebreak="n", **how).select("id", "n").collect(), key=str)
    assert join(hot_rows=200) == join(hot_rows=3) == join(hot_rows=0) == join(broadcast=True)
    assert join(hot_rows=200) == sorted([(i, max([(t2, n) for k2, t2, n in versions if k2 is not None and k2 == k and t2 and t and t2 <= t], default=(None, None))[1]) for i, k, t in facts], key=str)


def test_small_inputs_are_not_searched_for_hot_keys(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, 1, at(i)) for i in range(50)], "id long, k long, t timestamp").write.parquet(str(tmp_path / "f"))
    f = spark.read.parquet(str(tmp_path / "f"))
    v = f.select("k", "t", F.col("id").alias("n"))
    searched = []
    monkeypatch.setattr(joins, "hot_slices", lambda *a: searched.append(a))
    joins.asof_join(f, v, on=["k"], left_ts="t", right_ts="t", prefix="v_")
    assert not searched
    monkeypatch.setattr(joins, "SMALL_BYTES", 10)
    joins.asof_join(f, v, on=["k"], left_ts="t", right_ts="t", prefix="v_")
    assert len(searched) == 1 and searched[0][3] == joins.HOT_ROWS
