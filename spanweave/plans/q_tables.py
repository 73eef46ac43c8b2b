"""Queries of the table family, over lineitem as a count table, orders and customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.operators import tables as tb
from spanweave.plans.registry import Registry
from spanweave.runtime import load

R = Registry()
SAMPLES = ["A", "N", "R"]
_COUNTS = """c AS (SELECT l_partkey AS gene, p_size::DOUBLE AS "Length", sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS "A",
 sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS "N", sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS "R"
 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_partkey, p_size)"""


def counts(spark: SparkSession, d: str) -> DataFrame:
    wide = load(spark, d, "lineitem").groupBy("l_partkey").agg(*[F.sum(F.when(F.col("l_returnflag") == s, F.col("l_quantity")).otherwise(0)).alias(s) for s in SAMPLES])
    size = load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("double").alias("Length"))
    return wide.join(size, "l_partkey").withColumnRenamed("l_partkey", "gene")


def _norm(name: str, expr: str, f) -> None:
    cols = ", ".join(f'round({expr.format(s)}, 4) AS "{s}"' for s in SAMPLES)

    def q(spark: SparkSession, d: str) -> DataFrame:
        return f(counts(spark, d)).select("gene", *[F.round(s, 4).alias(s) for s in SAMPLES])

    R.add(name, f"WITH {_COUNTS} SELECT gene, {cols} FROM c")(q)


_norm("cpm", '"{0}" * 1e6 / sum("{0}") OVER ()', lambda c: tb.cpm(c, SAMPLES))
_norm("rpkm", '"{0}" / "Length" * 1e9 / sum("{0}") OVER ()', lambda c: tb.rpkm(c, SAMPLES))
_norm("tpm", '"{0}" / "Length" * 1e3 * 1e6 / sum("{0}" / "Length" * 1e3) OVER ()', lambda c: tb.tpm(c, SAMPLES))


@R.add("normalise_cpm", f"""WITH {_COUNTS} SELECT gene, {', '.join(f'round_even("{s}" * 1e6 / sum("{s}") OVER (), 2) AS "{s}"' for s in SAMPLES)} FROM c WHERE "A" + "N" + "R" <> 0""")
def normalise_cpm(spark: SparkSession, d: str) -> DataFrame:
    return tb.normalise(counts(spark, d), SAMPLES, "CPM").select("gene", *SAMPLES)


@R.add("size_factors", f"""WITH {_COUNTS}, m AS (SELECT *, (ln("A") + ln("N") + ln("R")) / 3 AS m FROM c WHERE "A" > 0 AND "N" > 0 AND "R" > 0)
SELECT {', '.join(f'round(exp(median(ln("{s}") - m)), 6) AS "{s}"' for s in SAMPLES)} FROM m""")
def size_factors(spark: SparkSession, d: str) -> DataFrame:
    return tb.size_factors(counts(spark, d), SAMPLES).select(*[F.round(s, 6).alias(s) for s in SAMPLES])


_AGGS = {
    "max": "max(o_totalprice)", "min": "min(o_totalprice)", "sum": "round(sum(o_totalprice), 2)", "count": "count(o_totalprice)", "count_distinct": "count(DISTINCT o_orderstatus)",
    "first": "arg_min(o_orderstatus, o_orderkey)", "last": "arg_max(o_orderstatus, o_orderkey)", "mean": "round(avg(o_totalprice), 6)", "median": "round(median(o_totalprice), 6)",
    "collapse": "string_agg(o_orderstatus, ',' ORDER BY o_orderkey)",
    "distinct": "(SELECT string_agg(s, ',' ORDER BY k) FROM (SELECT o_orderstatus AS s, min(o_orderkey) AS k FROM orders i WHERE i.o_custkey = o.o_custkey GROUP BY o_orderstatus))",
}
for _m, _sql in _AGGS.items():
    _c = "o_totalprice" if "o_totalprice" in _sql else "o_orderstatus"

    def _q(spark: SparkSession, d: str, m: str = _m, c: str = _c) -> DataFrame:
        out = tb.merge_row(load(spark, d, "orders"), ["o_custkey"], [c], m, "o_orderkey", count=True).withColumnRenamed(c, "v")
        return out.withColumn("v", F.round("v", 2 if m == "sum" else 6)) if m in ("sum", "mean", "median") else out

    R.add(f"merge_row_{_m}", f"SELECT o_custkey, {_sql} AS v, count(*) AS count FROM orders o GROUP BY o_custkey")(_q)


@R.add("merge_row_first_rows", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k = 1")
def merge_row_first_rows(spark: SparkSession, d: str) -> DataFrame:
    return tb.merge_row(load(spark, d, "orders"), ["o_custkey"], [], "first", "o_orderkey").select("o_custkey", "o_orderkey")


def _names(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "nation").where("n_nationkey < 5").select(F.col("n_name").alias("name"))


_N = "(SELECT n_name FROM nation WHERE n_nationkey < 5)"


def _named(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    other = n.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ";").alias("all_names"))
    return n.join(other, "n_regionkey")


_NT = "(SELECT n_regionkey, n_nationkey, n_name, string_agg(n_name, ';' ORDER BY n_name) OVER (PARTITION BY n_regionkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS all_names FROM nation) t"
for _name, _mode, _ex, _cond in (
    ("name_filter_in", "isin", False, f"n_name IN {_N}"),
    ("name_filter_exclude", "isin", True, f"n_name NOT IN {_N}"),
    ("name_filter_contains", "contains", False, "EXISTS (SELECT 1 FROM nation k WHERE k.n_nationkey < 5 AND contains(all_names, k.n_name))"),
    ("name_filter_token", "token", False, "EXISTS (SELECT 1 FROM nation k WHERE k.n_nationkey < 5 AND list_contains(string_split(all_names, ';'), k.n_name))"),
    ("name_filter_token_exclude", "token", True, "NOT EXISTS (SELECT 1 FROM nation k WHERE k.n_nationkey < 5 AND list_contains(string_split(all_names, ';'), k.n_name))"),
):

    def _f(spark: SparkSession, d: str, mode: str = _mode, ex: bool = _ex) -> DataFrame:
        return tb.name_filter(_named(spark, d), "n_name" if mode == "isin" else "all_names", _names(spark, d), mode, ex, ";").select("n_nationkey")

    R.add(_name, f"SELECT n_nationkey FROM {_NT} WHERE {_cond}")(_f)

_SPLICE = """s AS (SELECT event_id, value / 1000 AS "PValue", value / 500 AS "FDR", (value - 50) / 100 AS "IncLevelDifference",
 (user_id % 30)::VARCHAR || ',' || (user_id % 7)::VARCHAR AS a, (event_id % 20)::VARCHAR || ',' || (event_id % 9)::VARCHAR AS b, ((user_id % 30) + (user_id % 7)) / 2 AS ma, ((event_id % 20) + (event_id % 9)) / 2 AS mb FROM events)"""


def splice(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    a = F.concat_ws(",", (F.col("user_id") % 30).cast("string"), (F.col("user_id") % 7).cast("string"))
    b = F.concat_ws(",", (F.col("event_id") % 20).cast("string"), (F.col("event_id") % 9).cast("string"))
    return e.select(
        "event_id", (F.col("value") / 1000).alias("PValue"), (F.col("value") / 500).alias("FDR"), ((F.col("value") - 50) / 100).alias("IncLevelDifference"),
        a.alias("IJC_SAMPLE_1"), b.alias("SJC_SAMPLE_1"), a.alias("IJC_SAMPLE_2"), a.alias("SJC_SAMPLE_2"),
    )


@R.add("splice_filter", f"""WITH {_SPLICE} SELECT event_id, CASE WHEN "IncLevelDifference" > 0 THEN 'up' WHEN "IncLevelDifference" < 0 THEN 'down' ELSE 'none' END AS direction
FROM s WHERE "PValue" < 0.06 AND "FDR" < 0.1 AND abs("IncLevelDifference") > 0.1 AND ma + mb > 8 AND ma + ma > 8""")
def splice_filter(spark: SparkSession, d: str) -> DataFrame:
    return tb.splice_filter(splice(spark, d), 0.06, 0.1, 0.1, 8).select("event_id", "direction")


@R.add("outer_merge", """SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2
FROM (SELECT o_custkey, count(*) AS n1 FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) a FULL JOIN (SELECT o_custkey, count(*) AS n2 FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) b ON a.o_custkey = b.o_custkey""")
def outer_merge(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    return tb.outer_merge([o.where(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.count("*").alias(n)) for s, n in (("O", "n1"), ("F", "n2"))], ["o_custkey"])


@R.add("gene_info_merge", "SELECT c_custkey, c_name, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name")
def gene_info_merge(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return load(spark, d, "customer").select("c_custkey", "c_name").join(n, "c_custkey")


_PAIR = " UNION ALL ".join(f"""SELECT '{a}' AS a, '{b}' AS b, round(corr("{a}", "{b}"), 8) AS r FROM c WHERE "A" + "N" + "R" <> 0""" for a, b in (("A", "N"), ("A", "R"), ("N", "R")))


@R.add("corr_matrix", f"WITH {_COUNTS} {_PAIR}")
def corr_matrix(spark: SparkSession, d: str) -> DataFrame:
    return tb.pearson(counts(spark, d), SAMPLES).withColumn("r", F.round("r", 8))


@R.add("corr_pair", f"""WITH {_COUNTS} SELECT 'A' AS a, 'N' AS b, round(corr("A", "N"), 8) AS r FROM c WHERE "A" + "N" <> 0 AND least("A", "N") >= 1""")
def corr_pair(spark: SparkSession, d: str) -> DataFrame:
    return tb.pearson(counts(spark, d), ["A", "N"], 1).withColumn("r", F.round("r", 8))


@R.add("venn", """SELECT members, count(*) AS n FROM (SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus)) AS members FROM orders GROUP BY o_custkey) GROUP BY members""")
def venn(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    return tb.venn({s: o.where(F.col("o_orderstatus") == s) for s in ("O", "F", "P")}, "o_custkey")


@R.add("trimmed", """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events), w AS (SELECT event_id, value FROM events, q WHERE value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)),
m AS (SELECT min(value) AS lo, max(value) AS hi FROM w) SELECT event_id, value FROM w, m WHERE value > lo AND value < hi""")
def trimmed(spark: SparkSession, d: str) -> DataFrame:
    return tb.trimmed(load(spark, d, "events").select("event_id", "value"), "value")


@R.add("size_weights", """WITH s AS (SELECT event_type, length(event_type) + user_id % 9 AS size, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, size, n, sum(n) OVER (PARTITION BY event_type)::BIGINT AS total, first_value(size) OVER (PARTITION BY event_type ORDER BY n DESC, size) AS mode, n / sum(n) OVER (PARTITION BY event_type) AS weight FROM s""")
def size_weights(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "events").groupBy("event_type", (F.length("event_type") + F.col("user_id") % 9).alias("size")).agg(F.count("*").alias("n"))
    return tb.weights(s, "size", "n", ["event_type"])


@R.add("replicate_mean", "SELECT event_type, round(avg(value), 8) AS mean, round(stddev_samp(value) / sqrt(count(value)), 8) AS sem FROM events GROUP BY event_type")
def replicate_mean(spark: SparkSession, d: str) -> DataFrame:
    out = tb.grouped_mean(load(spark, d, "events"), ["event_type"], "value")
    return out.select("event_type", F.round("mean", 8).alias("mean"), F.round("sem", 8).alias("sem"))


@R.add("diff_labels", """SELECT event_id, CASE WHEN value / 500 <= 0.05 AND (user_id % 7) - 3 >= 1 THEN 'up' WHEN value / 500 <= 0.05 AND (user_id % 7) - 3 <= -1 THEN 'down' ELSE 'not' END AS label FROM events""")
def diff_labels(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").select("event_id", (F.col("user_id") % 7 - 3).alias("lfc"), (F.col("value") / 500).alias("padj"))
    return tb.diff_labels(e, "lfc", "padj").select("event_id", "label")


@R.add("rank_ends", "SELECT event_id, rank FROM (SELECT event_id, row_number() OVER (ORDER BY value, event_id) AS rank, count(*) OVER () AS c FROM events) WHERE rank <= 5 OR rank > c - 5")
def rank_ends(spark: SparkSession, d: str) -> DataFrame:
    return tb.ranked(load(spark, d, "events").select("event_id", "value"), "value", "event_id").select("event_id", "rank")


@R.add("top_labels", "SELECT p_name FROM (SELECT p_name FROM part WHERE p_size > 20 ORDER BY p_retailprice, p_name LIMIT 10) UNION SELECT p_name FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_partkey = 3)")
def top_labels(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part")
    names = [r.p_name for r in p.where("p_partkey = 3").select("p_name").collect()]  # one stated name
    return tb.top_labels(p, F.col("p_retailprice"), F.col("p_size") > 20, 10, names, "p_name")


@R.add("compare_matrix")
def compare_matrix(spark: SparkSession, d: str) -> DataFrame:
    c = counts(spark, d).withColumn("N2", F.col("N") / 2 + F.col("A"))
    return tb.compare_matrix(c, "gene", ["A", "R"], ["N", "N2"])
