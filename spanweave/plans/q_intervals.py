"""Queries of the interval family over bed6, bed12 and gtf."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.operators import intervals as I
from spanweave.plans.registry import Registry
from spanweave.runtime import load

R = Registry()
_A = """a AS (SELECT interval_id, chrom, start, "end" AS e, strand FROM bed6 WHERE chrom IS NOT NULL AND start IS NOT NULL AND "end" IS NOT NULL AND "end" >= start)"""
_B = """b AS (SELECT record_id, seqname AS chrom, start - 1 AS start, "end" AS e, strand FROM gtf WHERE feature = 'transcript' AND seqname IS NOT NULL)"""
_ON = "a.chrom = b.chrom AND a.e > b.start AND a.start < b.e"


def bed(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "bed6").select("interval_id", "chrom", "start", "end", "strand")


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d, "gtf").where("feature = 'transcript'")
    return g.select("record_id", F.col("seqname").alias("chrom"), (F.col("start") - 1).alias("start"), "end", "strand")


@R.add("overlap_count", f"WITH {_A}, {_B} SELECT record_id, count(*) AS n FROM a JOIN b ON {_ON} GROUP BY record_id")
def overlap_count(spark: SparkSession, d: str) -> DataFrame:
    return I.overlap_join(bed(spark, d), transcripts(spark, d), ["chrom"]).groupBy(F.col("record_id_b").alias("record_id")).agg(F.count("*").alias("n"))


@R.add("overlap_bp", f"WITH {_A}, {_B} SELECT record_id, sum(least(a.e, b.e) - greatest(a.start, b.start))::BIGINT AS bp FROM a JOIN b ON {_ON} GROUP BY record_id")
def overlap_bp(spark: SparkSession, d: str) -> DataFrame:
    pairs = I.overlap_join(bed(spark, d), transcripts(spark, d), ["chrom"])
    return pairs.groupBy(F.col("record_id_b").alias("record_id")).agg(F.sum(I.overlap_bases(F.col("start"), F.col("end"), F.col("start_b"), F.col("end_b"))).alias("bp"))


@R.add("overlap_strand", f"WITH {_A}, {_B} SELECT interval_id, record_id FROM a JOIN b ON {_ON} AND a.strand = b.strand")
def overlap_strand(spark: SparkSession, d: str) -> DataFrame:
    return I.overlap_join(bed(spark, d), transcripts(spark, d), ["chrom", "strand"]).select("interval_id", F.col("record_id_b").alias("record_id"))


@R.add("overlap_left", f"WITH {_A}, {_B} SELECT i.interval_id, count(b.record_id) AS n FROM bed6 i LEFT JOIN a ON a.interval_id = i.interval_id LEFT JOIN b ON {_ON} GROUP BY i.interval_id")
def overlap_left(spark: SparkSession, d: str) -> DataFrame:
    return I.overlap_join(bed(spark, d), transcripts(spark, d), ["chrom"], "left").groupBy("interval_id").agg(F.count("record_id_b").alias("n"))


def _near(cond: str, dist: str, extra: str = "") -> str:
    return f"""WITH {_A.replace(' AND "end" >= start', "")}, {_B}, p AS (SELECT interval_id, record_id, {dist} AS distance,
 row_number() OVER (PARTITION BY interval_id ORDER BY {dist}, record_id) AS k FROM a JOIN b ON a.chrom = b.chrom AND {cond} {extra})
SELECT interval_id, record_id, distance, k::INTEGER AS k FROM p WHERE k <= 2"""


def _near_out(df: DataFrame) -> DataFrame:
    return df.select("interval_id", F.col("record_id_b").alias("record_id"), "distance", F.col("_rank").alias("k"))


@R.add("nearest_before", _near("a.start - b.e BETWEEN 1 AND 2500", "a.start - b.e"))
def nearest_before(spark: SparkSession, d: str) -> DataFrame:
    return _near_out(I.nearest_interval(bed(spark, d).where("end IS NOT NULL"), transcripts(spark, d), ["chrom"], "before", ["record_id"], 2, ident="interval_id"))


@R.add("nearest_after", _near("b.start - a.e BETWEEN 1 AND 2500", "b.start - a.e"))
def nearest_after(spark: SparkSession, d: str) -> DataFrame:
    return _near_out(I.nearest_interval(bed(spark, d).where("start IS NOT NULL"), transcripts(spark, d), ["chrom"], "after", ["record_id"], 2, ident="interval_id"))


_UP = "CASE WHEN a.strand = '-' THEN b.start - a.e ELSE a.start - b.e END"
_DOWN = "CASE WHEN a.strand = '-' THEN a.start - b.e ELSE b.start - a.e END"


@R.add("upstream_of", _near(f"{_UP} BETWEEN 1 AND 2500", _UP))
def upstream_of(spark: SparkSession, d: str) -> DataFrame:
    return _near_out(I.nearest_interval(bed(spark, d).where("start IS NOT NULL AND end IS NOT NULL"), transcripts(spark, d), ["chrom"], "before", ["record_id"], 2, stranded=True, ident="interval_id"))


@R.add("downstream_of", _near(f"{_DOWN} BETWEEN 1 AND 2500", _DOWN))
def downstream_of(spark: SparkSession, d: str) -> DataFrame:
    return _near_out(I.nearest_interval(bed(spark, d).where("start IS NOT NULL AND end IS NOT NULL"), transcripts(spark, d), ["chrom"], "after", ["record_id"], 2, stranded=True, ident="interval_id"))


@R.add("interval_match", f"WITH {_A}, {_B} SELECT a.interval_id, c.interval_id AS other_id FROM a JOIN a c ON a.chrom = c.chrom AND a.strand = c.strand AND abs(a.start - c.start) <= 2 AND abs(a.e - c.e) <= 2 AND a.interval_id < c.interval_id AND a.e > c.start AND a.start < c.e")
def interval_match(spark: SparkSession, d: str) -> DataFrame:
    b = bed(spark, d)
    pairs = I.overlap_join(b, b, ["chrom", "strand"])
    ok = I.is_match(tuple(map(F.col, ("chrom", "start", "end", "strand"))), tuple(map(F.col, ("chrom_b", "start_b", "end_b", "strand_b"))))
    return pairs.where(ok & (F.col("interval_id") < F.col("interval_id_b"))).select("interval_id", F.col("interval_id_b").alias("other_id"))


def _runs_sql(source: str, name: str, keys: str = "chrom", gap: int = 0) -> str:
    strict = f"s > reach + {gap}"
    return f"""{name}_m AS (SELECT {keys}, s, e, max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT DISTINCT {keys}, s, e FROM {source})),
{name}_r AS (SELECT *, sum(CASE WHEN reach IS NULL OR {strict} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM {name}_m),
{name} AS (SELECT {keys}, min(s) AS start, max(e) AS "end" FROM {name}_r GROUP BY {keys}, run)"""


_S = """x AS (SELECT chrom, strand, start AS s, "end" AS e FROM bed6 WHERE chrom IS NOT NULL AND "end" > start),
y AS (SELECT seqname AS chrom, start - 1 AS s, "end" AS e FROM gtf WHERE feature = 'transcript' AND seqname IS NOT NULL)"""
_PTS = """pts AS (SELECT chrom, p, lead(p) OVER (PARTITION BY chrom ORDER BY p) AS q FROM (SELECT chrom, s AS p FROM x UNION SELECT chrom, e FROM x UNION SELECT chrom, s FROM y UNION SELECT chrom, e FROM y)),
seg AS (SELECT chrom, p AS s, q AS e FROM pts WHERE q IS NOT NULL AND """


@R.add("merge", f"WITH {_S}, {_runs_sql('x', 'r')} SELECT * FROM r")
def merge(spark: SparkSession, d: str) -> DataFrame:
    return I.merge(bed(spark, d), ["chrom"])


@R.add("merge_stranded", f"WITH {_S}, z AS (SELECT * FROM x WHERE strand IS NOT NULL), {_runs_sql('z', 'r', 'chrom, strand')} SELECT * FROM r")
def merge_stranded(spark: SparkSession, d: str) -> DataFrame:
    return I.merge(bed(spark, d), ["chrom", "strand"])


_IN = "EXISTS (SELECT 1 FROM {0} WHERE {0}.chrom = pts.chrom AND {0}.s < q AND {0}.e > p)"


def _algebra(cond: str) -> str:
    return f"WITH {_S}, {_PTS}{cond}), {_runs_sql('seg', 'r')} SELECT * FROM r"


@R.add("intersect", _algebra(_IN.format("x") + " AND " + _IN.format("y")))
def intersect(spark: SparkSession, d: str) -> DataFrame:
    return I.intersect(bed(spark, d), transcripts(spark, d), ["chrom"])


@R.add("subtract", _algebra(_IN.format("x") + " AND NOT " + _IN.format("y")))
def subtract(spark: SparkSession, d: str) -> DataFrame:
    return I.subtract(bed(spark, d), transcripts(spark, d), ["chrom"])


@R.add("symmetric_difference", _algebra(_IN.format("x") + " != " + _IN.format("y")))
def symmetric_difference(spark: SparkSession, d: str) -> DataFrame:
    return I.symmetric(bed(spark, d), transcripts(spark, d), ["chrom"])


@R.add(
    "complement",
    f"""WITH {_S}, z AS (SELECT chrom, max(e) AS n FROM y GROUP BY chrom), w AS (SELECT chrom, greatest(s, 0) AS s, least(e, n) AS e FROM x JOIN z USING (chrom) WHERE s < n AND e > 0),
w2 AS (SELECT chrom, s, e FROM w UNION ALL SELECT chrom, 0, 0 FROM z), {_runs_sql('w2', 'r')},
g AS (SELECT chrom, "end" AS start, lead(start) OVER (PARTITION BY chrom ORDER BY start) AS nxt FROM r)
SELECT chrom, g.start, coalesce(nxt, n) AS "end" FROM g JOIN z USING (chrom) WHERE coalesce(nxt, n) > g.start""",
)
def complement(spark: SparkSession, d: str) -> DataFrame:
    sizes = transcripts(spark, d).where("chrom IS NOT NULL").groupBy("chrom").agg(F.max("end").alias("length"))
    return I.complement(bed(spark, d), sizes, ["chrom"])


_DEPTH = f"""WITH {_S}, ev AS (SELECT chrom, p, sum(d) AS d FROM (SELECT chrom, s AS p, 1 AS d FROM x UNION ALL SELECT chrom, e, -1 FROM x) GROUP BY chrom, p HAVING sum(d) <> 0),
dp AS (SELECT chrom, p AS start, lead(p) OVER w AS "end", (sum(d) OVER w)::BIGINT AS depth FROM ev WINDOW w AS (PARTITION BY chrom ORDER BY p)) """


@R.add("depth_runs", _DEPTH + "SELECT * FROM dp WHERE depth > 0")
def depth_runs(spark: SparkSession, d: str) -> DataFrame:
    return I.depth(bed(spark, d), ["chrom"])


@R.add("bed_to_bedgraph", _DEPTH + """SELECT chrom, start, "end" - 1 AS "end", depth FROM dp WHERE depth > 0""")
def bed_to_bedgraph(spark: SparkSession, d: str) -> DataFrame:
    return I.depth(bed(spark, d), ["chrom"], inclusive_end=True)


@R.add("covered_bases", f'WITH {_S}, {_runs_sql("x", "r")} SELECT chrom, sum("end" - start)::BIGINT AS covered FROM r GROUP BY chrom')
def covered_bases(spark: SparkSession, d: str) -> DataFrame:
    return I.covered(bed(spark, d), ["chrom"])


@R.add(
    "cluster_slack",
    """WITH x AS (SELECT interval_id, chrom, start AS s, "end" AS e FROM bed6 WHERE chrom IS NOT NULL AND "end" > start),
m AS (SELECT *, max(e) OVER (PARTITION BY chrom ORDER BY s, e, interval_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x),
r AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY s, e, interval_id ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT chrom, min(s) AS start, max(e) AS "end", count(*) AS n, list_sort(list(interval_id)) AS ids FROM r GROUP BY chrom, run HAVING count(*) >= 2""",
)
def cluster_slack(spark: SparkSession, d: str) -> DataFrame:
    return I.cluster(bed(spark, d).where("end > start"), ["chrom"], 100, 2, "interval_id")
