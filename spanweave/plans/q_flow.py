"""Queries of the ordered-stream family, over events by event_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.operators import flow
from spanweave.plans.registry import Registry
from spanweave.runtime import load

R = Registry()


def ev(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", "user_id", "event_type", "value")


def _add(name: str, sql: str | None, f) -> None:
    R.add(name, sql)(lambda spark, d: f(ev(spark, d)))


_C = "event_id, user_id, event_type, value"
_add("flow_filter", f"SELECT {_C} FROM events WHERE value > 50", lambda e: flow.keep(e, F.col("value") > 50))
_add("flow_skip_while", f"SELECT {_C} FROM events WHERE NOT coalesce(value > 50, false)", lambda e: flow.skip_while(e, F.col("value") > 50))
_STOP = "(SELECT min(event_id) FROM events WHERE NOT coalesce(event_type <> 'purchase' OR event_id < 100, false))"


def _cond():
    return (F.col("event_type") != "purchase") | (F.col("event_id") < 100)


_add("flow_take_while", f"SELECT {_C} FROM events WHERE event_id < {_STOP}", lambda e: flow.take_while(e, _cond(), "event_id"))
_add("flow_drop_while", f"SELECT {_C} FROM events WHERE event_id >= {_STOP}", lambda e: flow.drop_while(e, _cond(), "event_id"))
_add("flow_map", "SELECT event_id, value * 2 AS twice FROM events", lambda e: flow.mapwith(e, twice=F.col("value") * 2).select("event_id", "twice"))
_add("flow_head", f"SELECT {_C} FROM events ORDER BY event_id LIMIT 10", lambda e: flow.head(e, "event_id"))
_add("flow_tail", f"SELECT {_C} FROM events ORDER BY event_id DESC LIMIT 10", lambda e: flow.tail(e, "event_id"))
_add("flow_skip", f"SELECT {_C} FROM events ORDER BY event_id OFFSET 25", lambda e: flow.skip(e, "event_id", 25))
_add("flow_islice", f"SELECT {_C} FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS n FROM events) WHERE n >= 5 AND n < 500 AND (n - 5) % 7 = 0", lambda e: flow.islice(e, "event_id", 5, 500, 7))
_add("flow_dedup", f"SELECT {_C} FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) WHERE k = 1", lambda e: flow.dedup(e, ["user_id", "event_type"], "event_id"))
_add("flow_uniq", f"SELECT {_C} FROM (SELECT *, lag(event_type) OVER (ORDER BY event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type", lambda e: flow.uniq(e, ["event_type"], "event_id"))
_add("flow_count", "SELECT count(*) AS count FROM events", flow.count)
_add(
    "flow_permutations",
    "WITH u AS (SELECT DISTINCT event_type AS v FROM events) SELECT a.v AS v0, b.v AS v1 FROM u a, u b WHERE a.v <> b.v",
    lambda e: flow.permutations(e.select("event_type").distinct().withColumn("o", F.col("event_type")), "event_type", "o"),
)
_add("flow_join", "SELECT user_id, string_agg(event_type, '|' ORDER BY event_id) AS joined FROM events GROUP BY user_id", lambda e: flow.join_text(e, "event_type", "event_id", "|", ["user_id"]))
_RUN = """WITH p AS (SELECT event_id, event_type, value, lag(event_type) OVER (ORDER BY event_id) AS p, lag(value) OVER (ORDER BY event_id) AS pv, row_number() OVER (ORDER BY event_id) AS n FROM events),
r AS (SELECT *, sum(CASE WHEN {} THEN 0 ELSE 1 END) OVER (ORDER BY event_id) AS g FROM p) SELECT min(event_id) AS run, {} list(event_id ORDER BY event_id) AS "values" FROM r GROUP BY g{}"""
_add("flow_kgroupby", _RUN.format("n > 1 AND p IS NOT DISTINCT FROM event_type", "event_type,", ", event_type"), lambda e: flow.kgroupby(e, ["event_type"], "event_id", "event_id"))
_add(
    "flow_groupby2_end",
    _RUN.format("n > 1 AND value - pv < 20", "", "").replace("list(event_id ORDER BY event_id)", "list(value ORDER BY event_id)"),
    lambda e: flow.groupby2_end(e, lambda a, b: b - a < 20, "value", "event_id"),
)
_add(
    "flow_groupby2_start",
    """WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
g AS (SELECT user_id, i, value, value AS first, 0 AS "group" FROM e WHERE i = 1
 UNION ALL SELECT e.user_id, e.i, e.value, CASE WHEN e.value - g.first < 20 THEN g.first ELSE e.value END, CASE WHEN e.value - g.first < 20 THEN "group" ELSE "group" + 1 END FROM g JOIN e ON e.user_id = g.user_id AND e.i = g.i + 1)
SELECT user_id, "group", list(value ORDER BY i) AS "values" FROM g GROUP BY ALL""",
    lambda e: flow.groupby2_start(e, lambda a, b: b - a < 20, "value", "event_id", ["user_id"]),
)
_add("flow_sort", f"SELECT {_C} FROM events ORDER BY value DESC, event_id", lambda e: flow.sort(e, ["value"], "event_id", True))
_add("flow_reverse", f"SELECT {_C} FROM events ORDER BY event_id DESC", lambda e: flow.reverse(e, "event_id"))
_add(
    "flow_transpose",
    "WITH r AS (SELECT event_id, [user_id, event_id] AS a FROM events), x AS (SELECT event_id, unnest(a) AS v, unnest(range(2)) AS pos FROM r) SELECT pos::INTEGER AS pos, list(v ORDER BY event_id) AS \"values\" FROM x GROUP BY pos",
    lambda e: flow.transpose(e.select("event_id", F.array("user_id", "event_id").alias("a")), "a", "event_id"),
)
_add(
    "flow_window",
    """WITH n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS n, count(*) OVER () AS c FROM events), f AS (SELECT max(c) AS c, (max(c) - 5) // 3 + 1 AS k FROM n),
w AS (SELECT unnest(range(k + 1)) AS w, k, c FROM f), m AS (SELECT w, k, f.c, event_id, n FROM w f JOIN n ON n >= w * 3 AND n < w * 3 + 5)
SELECT w * 3 AS start, list(event_id ORDER BY n) AS "values" FROM m WHERE w < k OR (k - 1) * 3 + 5 < c GROUP BY w""",
    lambda e: flow.window(e, "event_id", "event_id", 5, 3),
)
_add(
    "flow_round",
    """WITH n AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS n FROM events) SELECT h.n AS match, x.event_id, x.user_id, x.event_type, x.value
FROM n h JOIN n x ON x.n BETWEEN h.n - 1 AND h.n + 1 WHERE h.value > 95""",
    lambda e: flow.around(e, F.col("value") > 95, "event_id"),
)
_add("flow_flatten", "SELECT event_id, unnest([user_id, event_id]) AS v FROM events", lambda e: flow.flatten(e.select("event_id", F.array(F.array("user_id"), F.array("event_id")).alias("v")), "v", 2))
_add(
    "flow_concat",
    "SELECT event_id, user_id FROM events UNION ALL SELECT event_id - (SELECT min(event_id) FROM events) + (SELECT max(event_id) FROM events) + 1, user_id FROM events",
    lambda e: flow.concat(e.select("event_id", "user_id"), e.select("event_id", "user_id"), "event_id"),
)
_add("flow_nothing", f"SELECT {_C} FROM events", flow.nothing)
