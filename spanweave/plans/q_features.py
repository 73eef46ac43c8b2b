"""Queries of the feature, annotation, signal, read and sequence families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.functions import blocks as bl
from spanweave.functions import sequence as sq
from spanweave.functions.attributes import with_attributes
from spanweave.operators import annotate as an
from spanweave.operators import features as ft
from spanweave.operators import packed
from spanweave.operators import reads as rd
from spanweave.operators import signal as sg
from spanweave.plans.prepare import CELLS_SQL, PIECES_SQL
from spanweave.plans.registry import Registry
from spanweave.runtime import load

R = Registry()


_NAMES = ["gene_id", "transcript_id", "gene_name", "gene_type", "transcript_type"]


def gtf(spark: SparkSession, d: str) -> DataFrame:
    g = with_attributes(load(spark, d, "gtf").withColumnRenamed("seqname", "chrom"), _NAMES)
    return g.select("record_id", "chrom", "feature", "start", "end", "strand", *_NAMES, F.lit(None).cast("string").alias("transcript_name"))


_G = f"""ids AS ({CELLS_SQL % "true"} SELECT record_id, {", ".join(f"max(CASE WHEN col_name = '{c}' THEN cell END) AS {c}" for c in _NAMES)} FROM c GROUP BY record_id),
g AS (SELECT gtf.record_id, seqname AS chrom, feature, start, "end", strand, {", ".join(_NAMES)} FROM gtf LEFT JOIN ids ON gtf.record_id = ids.record_id),"""
_TX = (
    _G
    + """gt AS (SELECT gene_id, arg_min(gene_type, record_id) AS gt FROM g WHERE feature = 'gene' AND gene_id IS NOT NULL GROUP BY gene_id),
t0 AS (SELECT transcript_id, """
    + ", ".join(f"arg_min({c}, record_id) FILTER (WHERE feature = 'exon' AND {c} IS NOT NULL) AS {c}" for c in ("gene_id", "gene_name", "gene_type", "transcript_type", "chrom", "strand"))
    + """, min(start - 1) FILTER (WHERE feature = 'exon') AS start, max("end") FILTER (WHERE feature = 'exon') AS "end",
 min(start - 1) FILTER (WHERE feature IN ('CDS', 'stop_codon')) AS cds_start, max("end") FILTER (WHERE feature IN ('CDS', 'stop_codon')) AS cds_end,
 list_sort(list(DISTINCT {'s': start - 1, 'e': "end"}) FILTER (WHERE feature = 'exon')) AS exons
 FROM g WHERE transcript_id IS NOT NULL AND feature IN ('exon', 'CDS', 'stop_codon') GROUP BY transcript_id),
t AS (SELECT transcript_id, t0.gene_id, coalesce(gene_name, t0.gene_id) AS gene_name, coalesce(gene_type, gt) AS gene_type, coalesce(transcript_type, gene_type, gt) AS transcript_type, chrom, strand,
 start, "end", cds_start, cds_end, exons FROM t0 LEFT JOIN gt ON t0.gene_id = gt.gene_id WHERE start IS NOT NULL)"""
)


def tx(spark: SparkSession, d: str) -> DataFrame:
    return ft.transcripts(gtf(spark, d))


def _text(c: str) -> F.Column:
    return F.array_join(F.transform(c, lambda b: F.concat_ws("-", b["start"].cast("string"), b["end"].cast("string"))), ",").alias(c)


_ETEXT = "array_to_string(list_transform({0}, lambda x: x.s || '-' || x.e), ',')"


@R.add("transcript_agg", f"WITH {_TX} SELECT transcript_id, gene_id, gene_name, gene_type, transcript_type, chrom, strand, start, \"end\", cds_start, cds_end, {_ETEXT.format('exons')} AS exons FROM t")
def transcript_agg(spark: SparkSession, d: str) -> DataFrame:
    return tx(spark, d).select("transcript_id", "gene_id", "gene_name", "gene_type", "transcript_type", "chrom", "strand", "start", "end", "cds_start", "cds_end", _text("exons"))


@R.add("gene_union", f"""WITH {_TX}, e AS (SELECT DISTINCT gene_id, u.s AS s, u.e AS e FROM (SELECT gene_id, unnest(exons) AS u FROM t WHERE gene_id IS NOT NULL)),
m AS (SELECT *, max(e) OVER (PARTITION BY gene_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
r AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY gene_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM m),
x AS (SELECT gene_id, min(s) AS s, max(e) AS e FROM r GROUP BY gene_id, run)
SELECT a.*, b.exons FROM (SELECT gene_id, min(start) AS start, max("end") AS "end", min(cds_start) AS cds_start, max(cds_end) AS cds_end, count(*) AS n FROM t WHERE gene_id IS NOT NULL GROUP BY gene_id) a
JOIN (SELECT gene_id, string_agg(s || '-' || e, ',' ORDER BY s) AS exons FROM x GROUP BY gene_id) b ON a.gene_id = b.gene_id""")
def gene_union(spark: SparkSession, d: str) -> DataFrame:
    return ft.genes(tx(spark, d)).select("gene_id", "start", "end", "cds_start", "cds_end", "n", _text("exons"))


@R.add("introns_lead", f"""WITH {_G} e AS (SELECT DISTINCT transcript_id, chrom, strand, start - 1 AS s, "end" AS e FROM g WHERE feature = 'exon' AND transcript_id IS NOT NULL),
n AS (SELECT *, lead(s) OVER (PARTITION BY transcript_id ORDER BY s, e) AS nxt FROM e) SELECT transcript_id, chrom, e AS start, nxt AS "end", strand FROM n WHERE nxt > e""")
def introns_lead(spark: SparkSession, d: str) -> DataFrame:
    return ft.intron_rows(gtf(spark, d))


@R.add("introns_blocks", f"""WITH {_TX}, p AS (SELECT transcript_id, exons, unnest(range(1, len(exons))) AS i FROM t), q AS (SELECT transcript_id, i, exons[i].e AS s, exons[i + 1].s AS e FROM p)
SELECT transcript_id, string_agg(s || '-' || e, ',' ORDER BY i) AS introns FROM q WHERE s < e GROUP BY transcript_id""")
def introns_blocks(spark: SparkSession, d: str) -> DataFrame:
    t = tx(spark, d).withColumn("introns", bl.introns(F.col("exons")))
    return t.where(F.size("introns") > 0).select("transcript_id", _text("introns"))


_UTR = """u AS (SELECT *, CASE WHEN cds_start IS NULL THEN [] ELSE list_filter(list_transform(exons, lambda x: {'s': greatest(x.s, cds_start), 'e': least(x.e, cds_end)}), lambda x: x.s < x.e) END AS cds,
 CASE WHEN cds_start IS NULL THEN [] ELSE list_filter(list_transform(exons, lambda x: {'s': x.s, 'e': least(x.e, cds_start)}), lambda x: x.s < x.e) END AS lft,
 CASE WHEN cds_start IS NULL THEN [] ELSE list_filter(list_transform(exons, lambda x: {'s': greatest(x.s, cds_end), 'e': x.e}), lambda x: x.s < x.e) END AS rgt FROM t),
v AS (SELECT *, CASE WHEN strand = '-' THEN rgt ELSE lft END AS utr5, CASE WHEN strand = '-' THEN lft ELSE rgt END AS utr3 FROM u)"""


@R.add("utr_cds_split", f"WITH {_TX}, {_UTR} SELECT transcript_id, {_ETEXT.format('cds')} AS cds, {_ETEXT.format('utr5')} AS utr5, {_ETEXT.format('utr3')} AS utr3 FROM v")
def utr_cds_split(spark: SparkSession, d: str) -> DataFrame:
    c = (F.col("exons"), F.col("cds_start"), F.col("cds_end"))
    t = tx(spark, d).withColumns({"cds": bl.cds_exons(*c), "utr5": bl.utr5(*c, F.col("strand")), "utr3": bl.utr3(*c, F.col("strand"))})
    return t.select("transcript_id", _text("cds"), _text("utr5"), _text("utr3"))


@R.add("feature_lengths", f"WITH {_TX}, {_UTR}, w AS (SELECT transcript_id, \"end\" - start AS length, list_sum(list_transform(exons, lambda x: x.e - x.s))::BIGINT AS exons_len, len(exons)::INTEGER AS exons_count, "
    "coalesce(list_sum(list_transform(cds, lambda x: x.e - x.s)), 0)::BIGINT AS cds_len, coalesce(list_sum(list_transform(utr5, lambda x: x.e - x.s)), 0)::BIGINT AS utr5_len, coalesce(list_sum(list_transform(utr3, lambda x: x.e - x.s)), 0)::BIGINT AS utr3_len FROM v) SELECT * FROM w")
def feature_lengths(spark: SparkSession, d: str) -> DataFrame:
    return ft.lengths(tx(spark, d)).select("transcript_id", "length", "exons_len", "exons_count", "cds_len", "utr5_len", "utr3_len")


@R.add("tss_region", f"""WITH {_TX} SELECT transcript_id, CASE WHEN strand = '-' THEN "end" ELSE start END AS tss, CASE WHEN strand = '-' THEN "end" - 1000 ELSE start - 1000 END AS lo,
 CASE WHEN strand = '-' THEN "end" + 1000 ELSE start + 1000 END AS hi, CASE WHEN strand = '-' THEN start - 5000 ELSE "end" END AS d_lo, CASE WHEN strand = '-' THEN start ELSE "end" + 5000 END AS d_hi FROM t""")
def tss_region(spark: SparkSession, d: str) -> DataFrame:
    a = (F.col("start"), F.col("end"), F.col("strand"))
    up, dn = bl.tss_region(*a, -1000, 1000), bl.downstream(*a, 5000)
    return tx(spark, d).select("transcript_id", bl.tss(*a).alias("tss"), up["start"].alias("lo"), up["end"].alias("hi"), dn["start"].alias("d_lo"), dn["end"].alias("d_hi"))


_LOCI = f"""{_TX}, m AS (SELECT *, max("end") OVER (PARTITION BY chrom, strand ORDER BY start, "end", transcript_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM t WHERE chrom IS NOT NULL AND strand IS NOT NULL),
r AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chrom, strand ORDER BY start, "end", transcript_id ROWS UNBOUNDED PRECEDING) AS run FROM m),
l AS (SELECT chrom, strand, min(start) AS start, max("end") AS "end", string_agg(transcript_id, ',' ORDER BY transcript_id) AS transcript_id, count(*) AS count FROM r GROUP BY chrom, strand, run)"""


@R.add("loci_merge", f"WITH {_LOCI} SELECT * FROM l")
def loci_merge(spark: SparkSession, d: str) -> DataFrame:
    return ft.loci(tx(spark, d)).select("chrom", "strand", "start", "end", "transcript_id", "count")


@R.add("loci_gaps", f"""WITH {_LOCI}, z AS (SELECT seqname AS chrom, max("end") + 1000 AS length FROM gtf WHERE seqname IS NOT NULL GROUP BY 1), q AS (SELECT *, lag("end") OVER w AS p, lead(start) OVER w AS n FROM l WINDOW w AS (PARTITION BY chrom, strand ORDER BY start))
SELECT q.chrom, strand, start, "end", coalesce(start - p, start) AS before, coalesce(n - "end", length - "end") AS after FROM q JOIN z ON q.chrom = z.chrom""")
def loci_gaps(spark: SparkSession, d: str) -> DataFrame:
    sizes = load(spark, d, "gtf").where("seqname IS NOT NULL").groupBy(F.col("seqname").alias("chrom")).agg((F.max("end") + 1000).alias("length"))
    return ft.with_distances(ft.loci(tx(spark, d)), ["chrom", "strand"], sizes).select("chrom", "strand", "start", "end", "before", "after")


@R.add("gtf_to_bed6", f"""WITH {_G} x AS (SELECT 1) SELECT record_id, chrom, start - 1 AS start, "end", transcript_id AS name, '0' AS score, strand FROM g WHERE feature = 'exon'""")
def gtf_to_bed6(spark: SparkSession, d: str) -> DataFrame:
    g = gtf(spark, d).where("feature = 'exon'")
    return g.select("record_id", "chrom", (F.col("start") - 1).alias("start"), "end", F.col("transcript_id").alias("name"), F.lit("0").alias("score"), "strand")


@R.add("gtf_to_bed12", f"""WITH {_TX} SELECT chrom, start, "end", transcript_id AS name, strand, coalesce(cds_start, "end") AS "thickStart", coalesce(cds_end, "end") AS "thickEnd", len(exons)::INTEGER AS "blockCount",
 array_to_string(list_transform(exons, lambda x: x.e - x.s), ',') || ',' AS "blockSizes", array_to_string(list_transform(exons, lambda x: x.s - start), ',') || ',' AS "blockStarts" FROM t""")
def gtf_to_bed12(spark: SparkSession, d: str) -> DataFrame:
    return ft.bed12_rows(tx(spark, d)).drop("score", "itemRgb")


@R.add("gtf_gene_info", f"WITH {_G} x AS (SELECT 1) SELECT gene_id, coalesce(gene_name, gene_id) AS gene_name, gene_type, strand FROM g WHERE feature = 'gene'")
def gtf_gene_info(spark: SparkSession, d: str) -> DataFrame:
    return ft.gene_info(gtf(spark, d))


@R.add("gtf_trans_info", f"""WITH {_G} y AS (SELECT gene_id, arg_min(gene_type, record_id) AS gt FROM g WHERE feature = 'gene' AND gene_id IS NOT NULL GROUP BY gene_id)
SELECT coalesce(transcript_id, g.gene_id) AS transcript_id, coalesce(gene_name, g.gene_id) AS transcript_name, transcript_type, g.gene_id, coalesce(gene_name, g.gene_id) AS gene_name, coalesce(gene_type, gt) AS gene_type, strand
FROM g LEFT JOIN y ON g.gene_id = y.gene_id WHERE feature = 'transcript'""")
def gtf_trans_info(spark: SparkSession, d: str) -> DataFrame:
    return ft.trans_info(gtf(spark, d))


@R.add("gtf_filter", f"WITH {_G} x AS (SELECT 1) SELECT record_id FROM g WHERE feature = 'exon' AND gene_type IN ('lncRNA', 'snoRNA')")
def gtf_filter(spark: SparkSession, d: str) -> DataFrame:
    from spanweave.sources.text import filter_features

    return filter_features(gtf(spark, d), ["exon"], gene_type=["lncRNA", "snoRNA"]).select("record_id")


def _kind_sql(kind: str) -> str:
    pick = {"first_exon": "CASE WHEN strand = '-' THEN exons[-1:] ELSE exons[1:1] END", "last_exon": "CASE WHEN strand = '-' THEN exons[1:1] ELSE exons[-1:] END", "cds": "cds", "5utr": "utr5", "3utr": "utr3"}[kind]
    return f"WITH {_TX}, {_UTR}, k AS (SELECT transcript_id, {pick} AS blocks FROM v) SELECT transcript_id, {_ETEXT.format('blocks')} AS blocks FROM k WHERE len(blocks) > 0"


for _kind in ("first_exon", "last_exon", "cds", "5utr", "3utr"):

    def _region(spark: SparkSession, d: str, kind: str = _kind) -> DataFrame:
        return ft.region_blocks(tx(spark, d), kind).select("transcript_id", _text("blocks"))

    R.add(f"region_{_kind}", _kind_sql(_kind))(_region)


def _annotation(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    reads = load(spark, d, "bed6").where("end > start AND chrom IS NOT NULL").select(F.col("interval_id").alias("id"), "chrom", "start", "end", "strand")
    f = tx(spark, d).where("strand IN ('+', '-')").select(F.col("transcript_id").alias("id"), F.col("gene_name").alias("name"), F.col("transcript_type").alias("type"), "gene_type", "chrom", "start", "end", "strand", "cds_start", "cds_end", "exons")
    return reads, f


def _hit(x: str) -> str:
    return f"len(list_filter({x}, lambda x: x.e > rs AND x.s < re)) > 0"


_ANN = f"""{_TX}, {_UTR}, f AS (SELECT *, CASE WHEN strand = '-' THEN "end" ELSE start - 3000 END AS u1, CASE WHEN strand = '-' THEN "end" + 3000 ELSE start END AS u2,
 CASE WHEN strand = '-' THEN start - 3000 ELSE "end" END AS d1, CASE WHEN strand = '-' THEN start ELSE "end" + 3000 END AS d2, coalesce(transcript_type = 'protein_coding', false) AS pc FROM v WHERE strand IN ('+', '-')),
b AS (SELECT interval_id AS id, chrom AS rc, start AS rs, "end" AS re FROM bed6 WHERE "end" > start AND chrom IS NOT NULL),
h AS (SELECT *, list_sort([u1, u2, d1, d2]) AS pos FROM b JOIN f ON rc = chrom AND re > least(u1, d1) AND rs < greatest(u2, d2)),
c AS (SELECT id, transcript_id, gene_name, gene_type, transcript_type, pos, rs, re, list_filter([CASE WHEN re < pos[1] OR rs > pos[4] THEN 'Intergenic' END, CASE WHEN u2 > rs AND u1 < re THEN 'Upstream' END,
 CASE WHEN pc AND {_hit('utr5')} THEN '5UTR' END, CASE WHEN pc AND {_hit('utr3')} THEN '3UTR' END, CASE WHEN pc AND {_hit('cds')} THEN 'CDS' END, CASE WHEN NOT pc AND {_hit('exons')} THEN 'Exon' END,
 CASE WHEN d2 > rs AND d1 < re THEN 'Downstream' END], lambda x: x IS NOT NULL) AS l0 FROM h),
lab AS (SELECT id, transcript_id, gene_name, gene_type, transcript_type, CASE WHEN len(l0) = 0 THEN ['Intron'] WHEN NOT list_has_any(l0, ['5UTR', '3UTR', 'CDS', 'Exon']) AND pos[3] > rs AND pos[2] < re THEN list_append(l0, 'Intron') ELSE l0 END AS labels FROM c),
pr AS (SELECT *, list_filter([{', '.join(f"'{x}'" for x in an.PRIORITY)}], lambda p: list_contains(labels, p))[1] AS prim, list_has_any(labels, ['Upstream', 'Downstream', 'Intergenic']) AS flank FROM lab),
ti AS (SELECT *, CASE WHEN NOT flank AND prim <> 'Intron' THEN 1 WHEN flank AND list_has_any(labels, ['5UTR', '3UTR', 'CDS', 'Exon']) THEN 2 WHEN NOT flank THEN 3 WHEN list_contains(labels, 'Intron') THEN 4 ELSE 5 END AS tier FROM pr),
be AS (SELECT *, min(tier) OVER (PARTITION BY id) AS best FROM ti)"""


@R.add("annotate_labels", f"WITH {_ANN} SELECT id, transcript_id AS feature_id, array_to_string(list_sort(labels), ',') AS labels FROM lab")
def annotate_labels(spark: SparkSession, d: str) -> DataFrame:
    got = an.annotate_hits(*_annotation(spark, d))
    return got.where("feature_id IS NOT NULL").select("id", "feature_id", F.array_join(F.array_sort("labels"), ",").alias("labels"))


@R.add("annotate_tier", f"WITH {_ANN} SELECT id, transcript_id AS feature_id, tier FROM ti")
def annotate_tier(spark: SparkSession, d: str) -> DataFrame:
    return an.annotate_hits(*_annotation(spark, d)).where("feature_id IS NOT NULL").select("id", "feature_id", "tier")


@R.add("annotate_primary", f"""WITH {_ANN}, s AS (SELECT id, list_filter([{', '.join(f"'{x}'" for x in an.PRIORITY)}], lambda p: list_contains(list(prim), p))[1] AS anno, string_agg(DISTINCT transcript_id, ',' ORDER BY transcript_id) AS ids,
 coalesce(string_agg(DISTINCT gene_name, ',' ORDER BY gene_name), '*') AS names FROM be WHERE tier = best GROUP BY id)
SELECT b.id, coalesce(anno, 'Intergenic') AS anno, coalesce(ids, '*') AS ids, coalesce(names, '*') AS names FROM b LEFT JOIN s ON b.id = s.id""")
def annotate_primary(spark: SparkSession, d: str) -> DataFrame:
    return an.annotate(*_annotation(spark, d)).select("id", "anno", "ids", "names")


@R.add("annotate_types", f"""WITH {_ANN}, s AS (SELECT id, list_sort(list(DISTINCT gene_type) FILTER (gene_type IS NOT NULL)) AS gt, list_sort(list(DISTINCT transcript_type) FILTER (transcript_type IS NOT NULL)) AS ty FROM be WHERE tier = best GROUP BY id),
w AS (SELECT id, array_to_string(CASE WHEN coalesce(list_contains(gt, 'protein_coding'), false) AND NOT coalesce(list_contains(ty, 'protein_coding'), false) THEN ty ELSE gt END, ',') AS types FROM s)
SELECT b.id, coalesce(nullif(types, ''), '*') AS types FROM b LEFT JOIN w ON b.id = w.id""")
def annotate_types(spark: SparkSession, d: str) -> DataFrame:
    return an.annotate(*_annotation(spark, d)).select("id", "types")


_PEAK = f"[{', '.join(f"'{x}'" for x in an.PEAK_PRIORITY)}]"


@R.add("annotate_peaks", f"""WITH {_ANN.replace("[" + ", ".join(f"'{x}'" for x in an.PRIORITY) + "]", _PEAK)}, s AS (SELECT id, list_filter({_PEAK}, lambda p: list_contains(list(prim), p))[1] AS anno FROM be WHERE tier = best GROUP BY id)
SELECT b.id, coalesce(anno, 'Intergenic') AS anno FROM b LEFT JOIN s ON b.id = s.id""")
def annotate_peaks(spark: SparkSession, d: str) -> DataFrame:
    return an.annotate(*_annotation(spark, d), priority=an.PEAK_PRIORITY).select("id", "anno")


# signal tracks: the depth of bed6 by strand; regions: transcripts
def _track(spark: SparkSession, d: str) -> DataFrame:
    from spanweave.operators.intervals import depth

    b = load(spark, d, "bed6").where("strand IN ('+', '-')").withColumnRenamed("strand", "sample")
    return depth(b.select("sample", "chrom", "start", "end"), ["sample", "chrom"]).withColumnRenamed("depth", "value")


_TRACK = """ev AS (SELECT strand AS sample, chrom, p, sum(d) AS d FROM (SELECT strand, chrom, start AS p, 1 AS d FROM bed6 WHERE "end" > start AND chrom IS NOT NULL UNION ALL SELECT strand, chrom, "end", -1 FROM bed6 WHERE "end" > start AND chrom IS NOT NULL)
 WHERE strand IN ('+', '-') GROUP BY 1, 2, 3 HAVING sum(d) <> 0), tr0 AS (SELECT sample, chrom, p AS s, lead(p) OVER w AS e, sum(d) OVER w AS v FROM ev WINDOW w AS (PARTITION BY sample, chrom ORDER BY p)),
tr AS (SELECT * FROM tr0 WHERE v > 0), rg AS (SELECT record_id AS id, seqname AS chrom, start - 1 AS rs, "end" AS re, strand FROM gtf WHERE feature = 'transcript' AND seqname IS NOT NULL AND strand IN ('+', '-')),
pa AS (SELECT id, re - rs AS n, sample, greatest(s, rs) - rs AS s, least(e, re) - rs AS e, v FROM rg JOIN tr ON rg.chrom = tr.chrom AND e > rs AND s < re), al AS (SELECT id, re - rs AS n, sample FROM rg, (SELECT DISTINCT sample FROM tr))"""


def _regions(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d, "gtf").where("feature = 'transcript' AND seqname IS NOT NULL AND strand IN ('+', '-')")
    return g.select(F.col("record_id").alias("id"), F.col("seqname").alias("chrom"), (F.col("start") - 1).alias("start"), "end", "strand")


@R.add("signal_stats", f"""WITH {_TRACK}, q AS (SELECT id, sample, sum(e - s) AS n, sum(v * (e - s)) AS sm, max(v) AS mx, min(v) AS mi, sum(v * v * (e - s)) AS sq FROM pa GROUP BY id, sample)
SELECT al.id, al.sample, round(coalesce(sm / q.n, 0), 6) AS mean, coalesce(mx, 0)::DOUBLE AS max, coalesce(mi, 0)::DOUBLE AS min, coalesce(sm, 0)::DOUBLE AS sum, round(coalesce(q.n / al.n, 0), 6) AS coverage,
 round(coalesce(CASE WHEN q.n > 1 THEN sqrt(greatest((sq - sm * sm / q.n) / (q.n - 1), 0)) END, 0), 6) AS std FROM al LEFT JOIN q ON al.id = q.id AND al.sample = q.sample""")
def signal_stats(spark: SparkSession, d: str) -> DataFrame:
    got = sg.stats(_regions(spark, d), _track(spark, d))
    return got.select("id", "sample", F.round("mean", 6).alias("mean"), "max", "min", "sum", F.round("coverage", 6).alias("coverage"), F.round("std", 6).alias("std"))


def _bin_sql(width: str, n: int, value: str, where: str = "true") -> str:
    return f"""WITH {_TRACK}, w AS (SELECT *, {width} AS w FROM pa WHERE {where}), x AS (SELECT id, sample, v, s, e, w, unnest(range(s // w, least((e - 1) // w, {n} - 1) + 1)) AS bin FROM w WHERE w > 0),
y AS (SELECT id, sample, bin, sum({value} * (least(e, (bin + 1) * w) - greatest(s, bin * w))) / max(w) AS value FROM x GROUP BY id, sample, bin), z AS (SELECT id, sample, unnest(range({n})) AS bin FROM al)
SELECT z.id, z.sample, z.bin, round(coalesce(value, 0), 6) AS value FROM z LEFT JOIN y ON z.id = y.id AND z.sample = y.sample AND z.bin = y.bin"""


@R.add("signal_scale_region", _bin_sql("n // 20", 20, "v"))
def signal_scale_region(spark: SparkSession, d: str) -> DataFrame:
    return sg.scale_region(_regions(spark, d), _track(spark, d), 200, 10).withColumn("value", F.round("value", 6))


@R.add("signal_coverage_bins", f"""WITH {_TRACK}, x AS (SELECT id, sample, n, s * 10 AS s, e * 10 AS e, unnest(range(s * 10 // n, (e * 10 - 1) // n + 1)) AS bin FROM pa),
y AS (SELECT id, sample, bin, sum(least(e, (bin + 1) * n) - greatest(s, bin * n)) / max(n) AS value FROM x GROUP BY id, sample, bin), z AS (SELECT id, sample, unnest(range(10)) AS bin FROM al)
SELECT z.id, z.sample, z.bin, round(coalesce(value, 0), 6) AS value FROM z LEFT JOIN y ON z.id = y.id AND z.sample = y.sample AND z.bin = y.bin""")
def signal_coverage_bins(spark: SparkSession, d: str) -> DataFrame:
    return sg.coverage_bins(_regions(spark, d), _track(spark, d), 10, fractional=True).withColumn("value", F.round("value", 6))


# bases x samples of whole regions: too many rows for the SQL check, compared with brute force in tests/test_whole.py
@R.add("signal_sliding")
def signal_sliding(spark: SparkSession, d: str) -> DataFrame:
    return sg.sliding_coverage(_regions(spark, d), _track(spark, d), 100)


@R.add("signal_values")
def signal_values(spark: SparkSession, d: str) -> DataFrame:
    return sg.values(_regions(spark, d), _track(spark, d))


def _profile_sql(lo: str, hi: str, n: int) -> str:
    head = _TRACK.replace("pa AS (", f"wi AS (SELECT id, chrom, strand, CASE WHEN strand = '-' THEN {lo[1]} ELSE {lo[0]} END AS rs, CASE WHEN strand = '-' THEN {hi[1]} ELSE {hi[0]} END AS re FROM rg), pa AS (", 1)
    head = head.replace("FROM rg JOIN tr ON rg.chrom", "FROM wi JOIN tr ON wi.chrom")
    return f"""WITH {head}, x AS (SELECT id, sample, v, s, e, unnest(range(s // 10, (e - 1) // 10 + 1)) AS bin FROM pa),
y AS (SELECT sample, CASE WHEN strand = '-' THEN {n} - 1 - bin ELSE bin END AS bin, sum(v * (least(e, (bin + 1) * 10) - greatest(s, bin * 10)) / 10) AS value FROM x JOIN rg ON x.id = rg.id GROUP BY 1, 2),
z AS (SELECT sample, unnest(range({n})) AS bin FROM (SELECT DISTINCT sample FROM tr)) SELECT z.sample, z.bin, round(coalesce(value, 0) / (SELECT count(*) FROM rg), 6) AS value FROM z LEFT JOIN y ON z.sample = y.sample AND z.bin = y.bin"""


@R.add("profile_tss", _profile_sql(("rs - 2000", "re - 1000"), ("rs + 1000", "re + 2000"), 300))
def profile_tss(spark: SparkSession, d: str) -> DataFrame:
    return sg.reference_point(_regions(spark, d), _track(spark, d), "TSS", "reads", 2000, 1000, 10).withColumn("value", F.round("value", 6))


@R.add("profile_coverage", f"""WITH {_TRACK}, wi AS (SELECT id, chrom, strand, CASE WHEN strand = '-' THEN rs ELSE re END - 100 AS rs FROM rg),
q AS (SELECT sample, CASE WHEN strand = '-' THEN 190 - k ELSE k END AS bin, sum(least(e, rs + k + 10) - greatest(s, rs + k)) AS n
 FROM wi JOIN tr ON wi.chrom = tr.chrom AND e > rs AND s < rs + 200, (SELECT unnest(range(191)) AS k) WHERE s < rs + k + 10 AND e > rs + k GROUP BY 1, 2),
z AS (SELECT sample, unnest(range(191)) AS bin FROM (SELECT DISTINCT sample FROM tr)) SELECT z.sample, z.bin, round(coalesce(n, 0) / 10 / (SELECT count(*) FROM rg), 6) AS value FROM z LEFT JOIN q ON z.sample = q.sample AND z.bin = q.bin""")
def profile_coverage(spark: SparkSession, d: str) -> DataFrame:
    return sg.reference_point(_regions(spark, d), _track(spark, d), "TES", "coverage", 100, 100, 10).withColumn("value", F.round("value", 6))


@R.add("profile_signal_point", f"""WITH {_TRACK}, wi AS (SELECT id, chrom, strand, CASE WHEN strand = '-' THEN re ELSE rs END - 100 AS rs FROM rg),
q AS (SELECT sample, CASE WHEN strand = '-' THEN 199 - k ELSE k END AS bin, sum(v) AS n
 FROM wi JOIN tr ON wi.chrom = tr.chrom AND e > rs AND s < rs + 200, (SELECT unnest(range(200)) AS k) WHERE s <= rs + k AND e > rs + k GROUP BY 1, 2),
z AS (SELECT sample, unnest(range(200)) AS bin FROM (SELECT DISTINCT sample FROM tr)) SELECT z.sample, z.bin, round(coalesce(n, 0) / (SELECT count(*) FROM rg), 6) AS value FROM z LEFT JOIN q ON z.sample = q.sample AND z.bin = q.bin""")
def profile_signal_point(spark: SparkSession, d: str) -> DataFrame:
    return sg.signal_point(_regions(spark, d), _track(spark, d), "TSS", 100, 100).withColumn("value", F.round("value", 6))


@R.add("profile_body")
def profile_body(spark: SparkSession, d: str) -> DataFrame:
    return sg.scale_regions(_regions(spark, d), _track(spark, d), 500, 500, 1000, 10)


@R.add("profile_smooth")
def profile_smooth(spark: SparkSession, d: str) -> DataFrame:
    return sg.smooth(sg.scale_regions(_regions(spark, d), _track(spark, d), 500, 500, 1000, 10), 11, 3)


# sequences: document texts as letters
def _seq(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.col("text").alias("t"))


_CLEAN = "translate(regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^ACGTUWSMKRYBDHVNZ]', '', 'g'), 'U', 'T')"


@R.add("to_dna", f"SELECT doc_id, {_CLEAN} AS dna FROM documents")
def to_dna(spark: SparkSession, d: str) -> DataFrame:
    return _seq(spark, d).select("doc_id", sq.to_dna(F.col("t")).alias("dna"))


@R.add("to_rna", f"SELECT doc_id, translate({_CLEAN}, 'T', 'U') AS rna FROM documents")
def to_rna(spark: SparkSession, d: str) -> DataFrame:
    return _seq(spark, d).select("doc_id", sq.to_rna(F.col("t")).alias("rna"))


@R.add("revcomp", f"SELECT doc_id, reverse(translate(replace({_CLEAN}, 'Z', ''), 'ACGTNWSKMYRHBVD', 'TGCANWSMKRYDVBH')) AS rc FROM documents")
def revcomp(spark: SparkSession, d: str) -> DataFrame:
    return _seq(spark, d).select("doc_id", sq.reverse_complement(F.replace(sq.to_dna(F.col("t")), F.lit("Z"), F.lit(""))).alias("rc"))


@R.add("motif_count", f"SELECT doc_id, len(regexp_extract_all({_CLEAN}, 'A[CTU][ACGTU]G[AG]'))::INTEGER AS n FROM documents WHERE text IS NOT NULL")
def motif_count(spark: SparkSession, d: str) -> DataFrame:
    return _seq(spark, d).where("t IS NOT NULL").select("doc_id", F.size(sq.motif_all(sq.to_dna(F.col("t")), "AYNGR")).alias("n"))


@R.add("motif_first", f"SELECT doc_id, nullif(regexp_extract({_CLEAN}, 'A[CTU][ACGTU]G[AG]'), '') AS first, regexp_matches({_CLEAN}, '^[ACGTU]') AS starts FROM documents")
def motif_first(spark: SparkSession, d: str) -> DataFrame:
    s = sq.to_dna(F.col("t"))
    return _seq(spark, d).select("doc_id", sq.motif_first(s, "AYNGR").alias("first"), sq.motif_at_start(s, "N").alias("starts"))


@R.add("length_histogram", "SELECT length(text)::INTEGER AS length, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def length_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rd.length_histogram(_seq(spark, d), F.length("t"))



@R.add("dedup_sequences", "SELECT doc_id, length(text)::INTEGER AS n FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1 AND length(text) >= 15")
def dedup_sequences(spark: SparkSession, d: str) -> DataFrame:
    return rd.dedup_sequences(_seq(spark, d), ["t"], "doc_id", 15, ["t"]).select("doc_id", F.length("t").alias("n"))


@R.add("dedup_pairs", "SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY text, source ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def dedup_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rd.dedup_sequences(load(spark, d, "documents").select("doc_id", "text", "source"), ["text", "source"], "doc_id").select("doc_id")


@R.add("rename_duplicates", "SELECT bed_id, CASE WHEN k > 1 THEN name || '_' || k ELSE name END AS name FROM (SELECT bed_id, name, row_number() OVER (PARTITION BY name ORDER BY bed_id) AS k FROM bed12)")
def rename_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return rd.rename_duplicates(load(spark, d, "bed12").select("bed_id", "name"), "name", "bed_id")


# reads: rows of bed6 as alignments, named by their start, the strand as mate
def _mates(spark: SparkSession, d: str) -> DataFrame:
    b = load(spark, d, "bed6")
    return b.select("interval_id", F.concat("chrom", F.lit(":"), F.col("start").cast("string")).alias("qname"), F.when(F.col("strand") == "-", 2).otherwise(1).alias("mate"), F.col("chrom").alias("rname"), "start", "end")


_M = "m AS (SELECT interval_id, chrom || ':' || start AS qname, CASE WHEN strand = '-' THEN 2 ELSE 1 END AS mate, chrom AS rname, start FROM bed6), p AS (SELECT qname, " + ", ".join(
    f"max(interval_id) FILTER (WHERE mate = {i}) AS id{i}" for i in (1, 2)
) + " FROM m WHERE qname IS NOT NULL GROUP BY qname)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return rd.mate_pairs(_mates(spark, d), "qname", F.col("mate"), "interval_id", ["interval_id", "rname", "start"])


@R.add("mate_pairs", f"WITH {_M} SELECT * FROM p")
def mate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("qname", F.col("r1.interval_id").alias("id1"), F.col("r2.interval_id").alias("id2"))


@R.add("unpaired", f"WITH {_M} SELECT qname, CASE WHEN id2 IS NULL THEN 1 ELSE 2 END AS mate FROM p WHERE id1 IS NULL OR id2 IS NULL")
def unpaired(spark: SparkSession, d: str) -> DataFrame:
    return rd.unpaired(_pairs(spark, d)).select("qname", "mate")


@R.add("name_order", f"WITH {_M} SELECT CASE WHEN id1 IS NULL THEN 2 WHEN id2 IS NULL THEN 1 ELSE 0 END AS category, qname, mate, interval_id FROM (SELECT *, 1 AS mate, id1 AS interval_id FROM p UNION ALL SELECT *, 2, id2 FROM p) WHERE interval_id IS NOT NULL")
def name_order(spark: SparkSession, d: str) -> DataFrame:
    return rd.name_order(_pairs(spark, d), "qname").select("category", "qname", "mate", "interval_id")


@R.add("reference_count", f"""WITH {_M}, x AS (SELECT p.qname, a.rname AS ref FROM p JOIN m a ON a.interval_id = p.id1 UNION SELECT p.qname, b.rname FROM p JOIN m b ON b.interval_id = p.id2) SELECT ref, count(*) AS n FROM x WHERE ref IS NOT NULL GROUP BY ref""")
def reference_count(spark: SparkSession, d: str) -> DataFrame:
    return rd.reference_count(_pairs(spark, d), "rname")


@R.add("fragment_lengths", """SELECT "end" - start AS length, count(*) AS n FROM bed6 WHERE "end" IS NOT NULL AND start IS NOT NULL GROUP BY 1""")
def fragment_lengths(spark: SparkSession, d: str) -> DataFrame:
    return rd.length_histogram(_mates(spark, d), F.col("end") - F.col("start"))


@R.add("strand_inference", """WITH a AS (SELECT interval_id AS id, chrom, start AS s, "end" AS e, strand FROM bed6 WHERE chrom IS NOT NULL AND "end" >= start AND strand IN ('+', '-')),
b AS (SELECT seqname AS chrom, start - 1 AS s, "end" AS e, strand FROM gtf WHERE feature = 'gene' AND strand IS NOT NULL),
h AS (SELECT id, a.strand, string_agg(DISTINCT b.strand, ':' ORDER BY b.strand) AS g FROM a JOIN b ON a.chrom = b.chrom AND a.e > b.s AND a.s < b.e GROUP BY id, a.strand)
SELECT count(*) AS n, round(count(*) FILTER (WHERE strand = g) / count(*), 8) AS sense, round(count(*) FILTER (WHERE g IN ('+', '-') AND strand <> g) / count(*), 8) AS antisense, round(count(*) FILTER (WHERE g NOT IN ('+', '-')) / count(*), 8) AS undecided FROM h""")
def strand_inference(spark: SparkSession, d: str) -> DataFrame:
    reads = load(spark, d, "bed6").where("strand IN ('+', '-')").select(F.col("interval_id").alias("id"), "chrom", "start", "end", "strand", F.lit(0).alias("mate"))
    genes = load(spark, d, "gtf").where("feature = 'gene' AND strand IS NOT NULL").select(F.col("seqname").alias("chrom"), (F.col("start") - 1).alias("start"), "end", "strand")
    out = rd.strand_inference(reads, genes)
    return out.select("n", *[F.round(c, 8).alias(c) for c in ("sense", "antisense", "undecided")])


@R.add("bed12_exons", PIECES_SQL.replace("' ', ',', 'g') AS t FROM g", "' ', ',', 'g') AS t0 FROM g").replace("s AS (SELECT bed_id", "h2 AS (SELECT bed_id, field_name, regexp_replace(t0, ',$', '') AS t FROM h), s AS (SELECT bed_id").replace("AS a FROM h)", "AS a FROM h2)")
    + """, k AS (SELECT bed_id, list(v ORDER BY pos) FILTER (WHERE field_name = 'blockSizes') AS n, list(v ORDER BY pos) FILTER (WHERE field_name = 'blockStarts') AS s FROM u GROUP BY bed_id),
ok AS (SELECT * FROM k WHERE len(n) = len(s) AND len(list_filter(list_concat(n, s), lambda x: NOT regexp_full_match(x, '[+]?[0-9]+|-0*[1-9][0-9]*'))) = 0),
e AS (SELECT ok.bed_id, b.start + unnest(s)::BIGINT AS s, unnest(n)::BIGINT AS n FROM ok JOIN bed12 b ON b.bed_id = ok.bed_id), x AS (SELECT bed_id, string_agg(s || '-' || (s + n), ',' ORDER BY s, n) AS exons FROM e GROUP BY bed_id)
SELECT bed12.bed_id, exons FROM bed12 LEFT JOIN x ON bed12.bed_id = x.bed_id""")
def bed12_exons(spark: SparkSession, d: str) -> DataFrame:
    return packed.block_pairs(load(spark, d, "bed12")).select("bed_id", _text("blocks").alias("exons"))


def _keys(spark: SparkSession, d: str, table: str, key: str) -> DataFrame:
    """Keys as texts, which hold one another in many ways."""
    return load(spark, d, table).select(F.col(key).cast("string").alias("id"), F.col(key).cast("string").alias("sequence"))


@R.add("containment", "SELECT p_partkey::VARCHAR AS id_a, s_suppkey::VARCHAR AS id_b FROM part, supplier WHERE contains(p_partkey::VARCHAR, s_suppkey::VARCHAR)")
def containment(spark: SparkSession, d: str) -> DataFrame:
    return rd.containment(_keys(spark, d, "part", "p_partkey"), _keys(spark, d, "supplier", "s_suppkey"), 3).select("id_a", "id_b")


_HELD = "WITH g AS (SELECT s_suppkey::VARCHAR AS s FROM supplier), p AS (SELECT a.s AS id_a, b.s AS id_b, instr(a.s, b.s) - 1 AS l, length(a.s) - length(b.s) - instr(a.s, b.s) + 1 AS r FROM g a, g b WHERE contains(a.s, b.s) AND a.s <> b.s)"


def _contained(spark: SparkSession, d: str) -> DataFrame:
    g = _keys(spark, d, "supplier", "s_suppkey")
    return rd.containment(g, g, 2).where("id_a <> id_b")


@R.add("isoforms", f"{_HELD} SELECT id_a, id_b, CASE WHEN l > 0 AND r > 0 THEN '53' WHEN l > 0 THEN '5' WHEN r > 0 THEN '3' ELSE 'same' END AS kind, CASE WHEN l > 0 AND r > 0 THEN 'LR' WHEN l > 0 THEN 'L' WHEN r > 0 THEN 'R' ELSE '' END AS extra FROM p")
def isoforms(spark: SparkSession, d: str) -> DataFrame:
    return rd.isoforms(_contained(spark, d)).select("id_a", "id_b", "kind", "extra")


@R.add("containment_collapse", f"{_HELD}, t AS (SELECT DISTINCT id_a FROM p WHERE id_a NOT IN (SELECT id_b FROM p)), d AS (SELECT t.id_a, id_b FROM t JOIN p ON t.id_a = p.id_a), e AS (SELECT id_a, id_b FROM d UNION SELECT d.id_a, p.id_b FROM d JOIN p ON d.id_b = p.id_a) SELECT id_a, list_sort(list(id_b)) AS parts FROM e GROUP BY id_a")
def containment_collapse(spark: SparkSession, d: str) -> DataFrame:
    return rd.collapse_containment(_contained(spark, d))


@R.add("reverse_records", f"SELECT doc_id, reverse(translate(replace({_CLEAN}, 'Z', ''), 'ACGTNWSKMYRHBVD', 'TGCANWSMKRYDVBH')) AS sequence, reverse({_CLEAN}) AS quality FROM documents")
def reverse_records(spark: SparkSession, d: str) -> DataFrame:
    return rd.reverse_records(_seq(spark, d).select("doc_id", F.replace(sq.to_dna(F.col("t")), F.lit("Z"), F.lit("")).alias("sequence"), sq.to_dna(F.col("t")).alias("quality")))


@R.add("merge_subsequences", """WITH g AS (SELECT DISTINCT gene_name AS s FROM trans_info WHERE gene_name <> '') SELECT a.s AS id, a.s AS sequence, string_agg(b.s, ';' ORDER BY b.s) AS names
FROM g a JOIN g b ON contains(a.s, b.s) WHERE NOT EXISTS (SELECT 1 FROM g c WHERE contains(c.s, a.s) AND c.s <> a.s) GROUP BY a.s""")
def merge_subsequences(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d, "trans_info").where("gene_name IS NOT NULL").select(F.col("gene_name").alias("id"), F.col("gene_name").alias("sequence")).distinct()
    return rd.merge_subsequences(g, 4)


@R.add("exact_sample")
def exact_sample(spark: SparkSession, d: str) -> DataFrame:
    return rd.exact_sample(load(spark, d, "bed6"), 500, "interval_id").select("interval_id")


@R.add("random_regions")
def random_regions(spark: SparkSession, d: str) -> DataFrame:
    sizes = load(spark, d, "gtf").where("seqname IS NOT NULL").groupBy(F.col("seqname").alias("chrom")).agg(F.max("end").alias("length"))
    return rd.random_regions(sizes, 1000)


