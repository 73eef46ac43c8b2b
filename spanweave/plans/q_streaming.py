"""Streaming queries: a table whose parts arrive one after the other, the stream run to its end, its result table returned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.operators.intervals import merge
from spanweave.plans.prepare import RUNS_SQL
from spanweave.plans.registry import Registry
from spanweave.runtime import load, scratch
from spanweave.streaming import windows as W

R = Registry()
PARTS = 3


def _arrivals(df: DataFrame, time: str | None) -> list[DataFrame]:
    """The table in ``PARTS`` parts that arrive one after the other: by ``time`` (rows without one come first), or in any order."""
    if time is None:
        share = F.pmod(F.xxhash64(*df.columns), F.lit(PARTS))
        return [df.where(share == i) for i in range(PARTS)]
    cuts = df.agg(F.percentile_approx(F.unix_micros(F.col(time).cast("timestamp")), [i / PARTS for i in range(1, PARTS)])).first()[0] or [0] * (PARTS - 1)  # a few numbers
    part = sum((F.coalesce(F.unix_micros(F.col(time).cast("timestamp")) > c, F.lit(False)).cast("int") for c in cuts), F.lit(0))
    return [df.where(part == i) for i in range(PARTS)]


def _run(spark: SparkSession, d: str, table: str, build, mode: str = "append", time: str | None = "ts") -> DataFrame:
    """What the stream gave out, with the column ``batch``. The table's parts arrive one by one; each time the query goes on from its checkpoint.

    A batch is written to a folder of its own, over what an earlier attempt may have left there, so that a repeated batch changes nothing. In complete mode
    only the last batch counts.
    """
    df = load(spark, d, table)
    path = scratch(spark, "stream")
    df.limit(0).write.parquet(f"{path}/in")
    out = build(spark.readStream.schema(df.schema).parquet(f"{path}/in"))
    kept = spark.createDataFrame([], out.schema)
    kept.write.parquet(f"{path}/out/batch=-1")

    def keep(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={i}")

    for part in _arrivals(df, time):
        part.write.mode("append").parquet(f"{path}/in")
        q = out.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        if q.exception():
            raise q.exception()
    got = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in out.schema)}, batch bigint").parquet(f"{path}/out")
    if mode == "complete":
        return got.where(F.col("batch") == got.agg(F.max("batch").alias("last")).scalar())
    return got


def _latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Update mode: of each key the rows of the last batch that gave any."""
    last = updates.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return updates.join(last, [*keys, "batch"])


def _ntz(df: DataFrame) -> DataFrame:
    return df.drop("batch").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


# complete mode gives out every window, open ones included
@R.add("stream_tumbling", """SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS window_end, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3""")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return _ntz(_run(spark, d, "events", lambda s: W.tumbling(W.as_timestamp(s), "ts", "1 day", "30 days", ["event_type"]), "complete"))


@R.add("stream_sliding", """WITH w AS (SELECT time_bucket(INTERVAL '12 hours', ts) - INTERVAL '12 hours' * k AS window_start, event_type FROM events, (VALUES (0), (1)) t(k))
SELECT window_start, window_start + INTERVAL '1 day' AS window_end, event_type, count(*) AS n FROM w GROUP BY 1, 2, 3""")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    return _ntz(_run(spark, d, "events", lambda s: W.sliding(W.as_timestamp(s), "ts", "1 day", "12 hours", "30 days", ["event_type"]), "complete"))


@R.add("stream_session", """WITH p AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), r AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL '2 hours' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM p)
SELECT min(ts) AS window_start, max(ts) + INTERVAL '2 hours' AS window_end, user_id, count(*) AS n FROM r GROUP BY user_id, g""")
def stream_session(spark: SparkSession, d: str) -> DataFrame:
    return _ntz(_run(spark, d, "events", lambda s: W.sessions(W.as_timestamp(s), "ts", "2 hours", "30 days", ["user_id"]), "complete"))


@R.add("batch_session", """WITH p AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), r AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL '2 hours' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM p)
SELECT min(ts) AS window_start, max(ts) + INTERVAL '2 hours' AS window_end, user_id, count(*) AS n FROM r GROUP BY user_id, g""")
def batch_session(spark: SparkSession, d: str) -> DataFrame:
    return _ntz(W.sessions(W.as_timestamp(load(spark, d, "events")), "ts", "2 hours", "0 seconds", ["user_id"]))


@R.add("stream_dedup", "SELECT user_id, event_type FROM events GROUP BY ALL")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d, "events", lambda s: W.running_dedup(W.as_timestamp(s), "ts", "3650 days", ["user_id", "event_type"])).select("user_id", "event_type")


@R.add("stream_greedy", """WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
g AS (SELECT user_id, i, value, value AS first, 0 AS grp FROM e WHERE i = 1
 UNION ALL SELECT e.user_id, e.i, e.value, CASE WHEN e.value - g.first < 20 THEN g.first ELSE e.value END, CASE WHEN e.value - g.first < 20 THEN grp ELSE grp + 1 END FROM g JOIN e ON e.user_id = g.user_id AND e.i = g.i + 1)
SELECT user_id, any_value(first) AS first, arg_max(value, i) AS last, count(*) AS n FROM g GROUP BY user_id, grp""")
def stream_greedy(spark: SparkSession, d: str) -> DataFrame:
    updates = _run(spark, d, "events", lambda s: W.greedy_groups(W.as_timestamp(s), "user_id", "ts", "value", 20.0), "update")
    return W.latest_groups(updates, "user_id").select("user_id", "first", "last", "n")


@R.add("stream_rename", "SELECT event_id, event_type || CASE WHEN k > 1 THEN '_' || k ELSE '' END AS event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events)")
def stream_rename(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d, "events", lambda s: W.running_names(W.as_timestamp(s).select("event_id", "event_type", "ts"), "event_type", "ts", "event_id")).select("event_id", "event_type")


@R.add("stream_coverage", RUNS_SQL + "SELECT chrom, strand, span_start, span_end FROM x")
def stream_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = _run(spark, d, "bed6", lambda s: W.coverage_updates(s.where("strand IN ('+', '-')"), ["chrom", "strand"]), "update", None)
    tiles = _latest(rows, ["chrom", "strand", "tile"]).select("chrom", "strand", F.col("span_start").alias("start"), F.col("span_end").alias("end"))
    return merge(tiles, ["chrom", "strand"]).withColumnsRenamed({"start": "span_start", "end": "span_end"})
