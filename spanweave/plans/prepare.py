"""Queries p1 to p5 of the general problems, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.functions.attributes import with_attributes
from spanweave.operators import badrows, coverage, hotkeys, packed, wide
from spanweave.plans.registry import Registry
from spanweave.runtime import load

R = Registry()
GAP_AT_MOST = 50_000

_TEXT = "WITH r AS (SELECT line_id, kind, CASE WHEN right(line, 1) = chr(13) THEN left(line, length(line) - 1) ELSE line END AS l FROM raw_lines), "
_CLASS = (
    _TEXT
    + r"""p AS (SELECT line_id, kind, l, string_split(l, chr(9)) AS c FROM r WHERE l <> '' AND NOT starts_with(l, '#')),
k AS (SELECT line_id, kind, l, c,
  NOT regexp_full_match(c[9], '\s*[^\s";]+\s+("[^"]*"|[^\s";]+)\s*(;\s*[^\s";]+\s+("[^"]*"|[^\s";]+)\s*)*;?\s*') AS broken,
  (length(c[9]) - length(replace(c[9], '"', ''))) % 2 = 1
    OR contains(regexp_replace(regexp_replace(replace(c[9], ';', ';;') || ';', '(^|;)(\s*[^\s";]+\s+)"[^"]*"(\s*;)', '\1\2v\3', 'g'), '^$', ''), '"') AS odd,
  CASE kind WHEN 'gtf' THEN c[6] = '.' OR regexp_full_match(c[6], '[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?')
    ELSE regexp_full_match(c[5], '0*([0-9]{1,3}|1000)') END AS fine FROM p),
w AS (SELECT line_id, kind, c, CASE WHEN len(c) <> (CASE kind WHEN 'gtf' THEN 9 ELSE 12 END) THEN 'column_count'
  WHEN kind = 'gtf' AND broken AND odd THEN 'quoting' WHEN kind = 'gtf' AND broken OR NOT fine THEN 'value' END AS reason FROM k) """
)


@R.add("p1_found", _CLASS + "SELECT line_id, reason FROM w WHERE reason IS NOT NULL")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return badrows.failing_lines(load(spark, d, "raw_lines"))


@R.add(
    "p1_gtf_loaded",
    _CLASS
    + """SELECT line_id, c[1] AS seqname, c[2] AS source, c[3] AS feature, c[4]::BIGINT AS start, c[5]::BIGINT AS "end", nullif(c[6], '.')::DOUBLE AS score, c[7] AS strand, c[8] AS frame,
 c[9] AS attributes FROM w WHERE reason IS NULL AND kind = 'gtf'""",
)
def p1_gtf_loaded(spark: SparkSession, d: str) -> DataFrame:
    return badrows.sound_records(load(spark, d, "raw_lines"), "gtf")


@R.add(
    "p1_bed12_loaded",
    _CLASS
    + """SELECT line_id, c[1] AS chrom, c[2]::BIGINT AS start, c[3]::BIGINT AS "end", c[4] AS name, c[5]::INTEGER AS score, c[6] AS strand, c[7]::BIGINT AS "thickStart",
 c[8]::BIGINT AS "thickEnd", c[9] AS "itemRgb", c[10]::INTEGER AS "blockCount", c[11] AS "blockSizes", c[12] AS "blockStarts" FROM w WHERE reason IS NULL AND kind = 'bed12'""",
)
def p1_bed12_loaded(spark: SparkSession, d: str) -> DataFrame:
    return badrows.sound_records(load(spark, d, "raw_lines"), "bed12")


PIECES_SQL = r"""WITH f AS (SELECT bed_id, 'blockSizes' AS field_name, "blockSizes" AS t FROM bed12 UNION ALL SELECT bed_id, 'blockStarts', "blockStarts" FROM bed12),
g AS (SELECT bed_id, field_name, regexp_replace(regexp_replace(t, '["'']', '', 'g'), '[\s\x{00a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]+', ' ', 'g') AS t FROM f),
h AS (SELECT bed_id, field_name, regexp_replace(regexp_replace(trim(t), ' ?[,;:|/，] ?', ',', 'g'), ' ', ',', 'g') AS t FROM g WHERE t <> ''),
s AS (SELECT bed_id, field_name, string_split(t, ',') AS a FROM h),
u AS (SELECT bed_id, field_name, unnest(a) AS v, unnest(range(len(a))) AS pos FROM s) """


@R.add("p2_found", PIECES_SQL + "SELECT bed_id, field_name, pos, v::BIGINT AS val FROM u WHERE regexp_full_match(v, '[+]?[0-9]+|-0*[1-9][0-9]*')")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return packed.block_list(load(spark, d, "bed12"))


_PAIRS_SQL = r"""regexp_extract_all(t, '[\s;]*([^\s;="'']+)(?:\s*=\s*|\s+)("[^"]*"\s*;|''.*?''\s*;|[^;]*;)', {})"""
CELLS_SQL = (
    f"""WITH a AS (SELECT record_id, attributes || ';' AS t FROM gtf WHERE %s),
p AS (SELECT record_id, unnest({_PAIRS_SQL.format(1)}) AS k, unnest({_PAIRS_SQL.format(2)}) AS v, unnest(range(len({_PAIRS_SQL.format(1)}))) AS pos FROM a),"""
    + r"""q AS (SELECT record_id, pos, lower(k) AS k, trim(regexp_replace(v, '\s*;$', '')) AS v FROM p),
n AS (SELECT record_id, pos, CASE k WHEN 'gene' THEN 'gene_name' WHEN 'gene_biotype' THEN 'gene_type' WHEN 'transcript_biotype' THEN 'transcript_type' ELSE k END AS k,
 trim(CASE WHEN length(v) > 1 AND v[1] IN ('"', chr(39)) AND v[-1] = v[1] THEN v[2:-2] ELSE v END) AS v FROM q),
m AS (SELECT * FROM n WHERE v NOT IN ('', '.')),
c AS (SELECT record_id, k AS col_name, first(v ORDER BY pos) AS cell FROM m
 WHERE k IN ('gene_id', 'transcript_id', 'gene_name', 'gene_type', 'transcript_type') GROUP BY record_id, k
 UNION ALL SELECT record_id, k, string_agg(v, ',' ORDER BY pos) FROM m WHERE k = 'tag' GROUP BY record_id, k
 UNION ALL SELECT record_id, k, first(v::BIGINT ORDER BY pos)::VARCHAR FROM m
 WHERE k IN ('exon_number', 'level', 'support') AND regexp_full_match(v, '[+-]?[0-9]+') GROUP BY record_id, k) """
)

@R.add(
    "p3_found",
    """SELECT 'gtf.seqname' AS field_name, seqname AS key_value FROM gtf WHERE seqname IS NOT NULL GROUP BY seqname HAVING count(*) >= 0.05 * (SELECT count(*) FROM gtf)
UNION ALL SELECT 'trans_info.gene_id', gene_id FROM trans_info WHERE gene_id IS NOT NULL GROUP BY gene_id HAVING count(*) >= 0.05 * (SELECT count(*) FROM trans_info)""",
)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return hotkeys.heavy_keys(load(spark, d, "gtf"), "seqname", "gtf.seqname").unionByName(hotkeys.heavy_keys(load(spark, d, "trans_info"), "gene_id", "trans_info.gene_id"))


@R.add(
    "p3_seqname",
    CELLS_SQL % "true"
    + """SELECT seqname, count(*) AS n_rows, min(start) AS min_start, max("end") AS max_end, count(DISTINCT cell) AS n_transcripts
 FROM gtf LEFT JOIN (SELECT record_id, cell FROM c WHERE col_name = 'transcript_id') i ON gtf.record_id = i.record_id WHERE seqname IS NOT NULL GROUP BY seqname""",
)
def p3_seqname(spark: SparkSession, d: str) -> DataFrame:
    gtf = with_attributes(load(spark, d, "gtf"), ["transcript_id"])
    return hotkeys.key_results(gtf, "seqname", "start", "end", "transcript_id").toDF("seqname", "n_rows", "min_start", "max_end", "n_transcripts")


@R.add(
    "p3_gene",
    CELLS_SQL % "true"
    + """, e AS (SELECT cell AS gene_id, min(start) AS min_start, max("end") AS max_end FROM c JOIN gtf ON c.record_id = gtf.record_id WHERE col_name = 'gene_id' GROUP BY cell)
SELECT gene_id, n_rows, n_transcripts, min_start, max_end FROM (SELECT gene_id, count(*) AS n_rows, count(DISTINCT transcript_id) AS n_transcripts FROM trans_info
 WHERE gene_id IS NOT NULL GROUP BY gene_id) LEFT JOIN e USING (gene_id)""",
)
def p3_gene(spark: SparkSession, d: str) -> DataFrame:
    rows = hotkeys.key_results(load(spark, d, "trans_info"), "gene_id", None, None, "transcript_id")
    extent = hotkeys.key_profile(with_attributes(load(spark, d, "gtf"), ["gene_id"]), "gene_id", "start", "end")
    extent = extent.select("gene_id", F.col("min_low").alias("min_start"), F.col("max_high").alias("max_end"))
    return rows.select("gene_id", "n_rows", F.col("n_members").alias("n_transcripts")).join(extent, "gene_id", "left")


_WIDE = ", ".join(f"max(CASE WHEN col_name = '{c}' THEN cell END)::{'BIGINT' if k == 'bigint' else 'VARCHAR'} AS {c}" for c, k in wide.GTF_COLUMNS.items())


@R.add("p4_found", CELLS_SQL % "source = 'curated'" + "SELECT * FROM c")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    got = wide.gtf_wide(load(spark, d, "gtf").where(F.col("source") == "curated"))
    return wide.cells(got, "record_id", list(wide.GTF_COLUMNS))


@R.add("p4_wide", CELLS_SQL % "true" + f"SELECT g.record_id, {_WIDE} FROM gtf g LEFT JOIN c ON g.record_id = c.record_id GROUP BY g.record_id")
def p4_wide(spark: SparkSession, d: str) -> DataFrame:
    return wide.gtf_wide(load(spark, d, "gtf"))


RUNS_SQL = """WITH i AS (SELECT DISTINCT chrom, strand, start AS s, "end" AS e FROM bed6 WHERE chrom IS NOT NULL AND "end" > start AND strand IN ('+', '-')),
m AS (SELECT *, max(e) OVER (PARTITION BY chrom, strand ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
r AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chrom, strand ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM m),
x AS (SELECT chrom, strand, min(s) AS span_start, max(e) AS span_end FROM r GROUP BY chrom, strand, run),
g AS (SELECT chrom, strand, span_end AS span_start, lead(span_start) OVER (PARTITION BY chrom, strand ORDER BY span_start) AS span_end FROM x) """


@R.add(
    "p5_found",
    RUNS_SQL + f"""SELECT 'merged' AS kind, chrom, strand, span_start, span_end FROM x
UNION ALL SELECT 'gap', chrom, strand, span_start, span_end FROM g WHERE span_end - span_start <= {GAP_AT_MOST}""",
)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "bed6").where(F.col("strand").isin("+", "-"))
    got = coverage.stretches(rows, ["chrom", "strand"])
    return got.where((F.col("kind") == "merged") | (F.col("span_end") - F.col("span_start") <= GAP_AT_MOST))
