"""Keyed-state operators over small file streams of several batches."""

import datetime as dt
import random

import pytest

import __spark_entry__ as entry
from spanweave.operators import flow
from spanweave.operators.coverage import IntervalMap
from spanweave.streaming import windows as W


@pytest.fixture
def run(spark, tmp_path):
    def go(rows, schema, build, mode="append", files=3):
        src = tmp_path / "in"
        for i in range(files):
            spark.createDataFrame(rows[i::files], schema).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
        got = []
        q = build(stream).writeStream.outputMode(mode).foreachBatch(lambda df, i: got.append([tuple(r) for r in df.collect()])).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return got

    return go


def test_interval_state(run):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "hot", "hot", None]), s := rng.randint(-30, 90), s + rng.choice([0, 1, 3, 9])) for _ in range(120)]
    batches = run(rows, "chrom string, start long, end long", lambda s: W.coverage_updates(s, ["chrom"], 1 << 10), "update")
    last = {}
    for b in batches:
        for c in {r[0] for r in b}:
            last.update({(c, t): sorted((r[2], r[3]) for r in b if r[:2] == (c, t)) for t in {r[1] for r in b if r[0] == c}})
    want = {}
    for c, s, e in rows:
        if c is not None and e > s:
            want.setdefault((c, s >> 10), IntervalMap()).add(s, e)
    assert last == {k: list(zip(m.starts, m.ends)) for k, m in want.items()}


def test_running_names(run):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("x", t0), ("y", t0), ("x", t0 + dt.timedelta(1)), ("x", t0 + dt.timedelta(2))]
    got = sorted(r[0] for b in run(rows, "name string, ts timestamp", lambda s: W.running_names(s, "name", "ts")) for r in b)
    assert got == ["x", "x_2", "x_3", "y"]


def test_dedup_within_watermark(run):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i % 4, t0 + dt.timedelta(minutes=i)) for i in range(24)]
    got = [r[0] for b in run(rows, "k long, ts timestamp", lambda s: W.running_dedup(s, "ts", "1 day", ["k"])) for r in b]
    assert sorted(got) == [0, 1, 2, 3]


def test_greedy_groups_keep_the_open_group(spark, run):
    t0, rng = dt.datetime(2024, 1, 1), random.Random(9)
    rows = [(i % 7 if i < 118 else i, t0 + dt.timedelta(minutes=i), rng.choice([None, *map(float, range(60))])) for i in range(120)]
    files = [rows[f * 40 + j] for j in range(40) for f in range(3)]  # the files follow one another in time
    schema = "k long, ts timestamp, v double"
    batches = run(files, schema, lambda s: W.greedy_groups(s, "k", "ts", "v", 20.0), "update")
    updates = spark.createDataFrame([r for b in batches for r in b], "k long, group long, first double, last double, n long")
    got = {(r.k, r.group): (r["first"], r["last"], r.n) for r in W.latest_groups(updates, "k").collect()}
    want = flow.groupby2_start(spark.createDataFrame(rows, schema), lambda a, b: b - a < 20, "v", "ts", ["k"]).collect()
    assert got == {(r.k, r.group): (r["values"][0], r["values"][-1], len(r["values"])) for r in want}
    assert len(batches) == 3 and got[119, 0][2] == 1


def test_stream_greedy_query(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, u, t0 + dt.timedelta(minutes=i), v) for i, (u, v) in enumerate([(1, 5.0), (1, 9.0), (1, 40.0), (2, 7.0), (1, 41.0)])]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in entry.queries()["stream_greedy"](spark, str(tmp_path)).select("user_id", "first", "last", "n").collect())
    assert got == [(1, 5.0, 9.0, 2), (1, 40.0, 41.0, 2), (2, 7.0, 7.0, 1)]
