"""Queries through the sources and sinks: driver tables written in a format and read back; logs, and functions of their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.functions import blocks as bl
from spanweave.functions import sequence as sq
from spanweave.functions.attributes import attribute_map
from spanweave.operators import annotate as an
from spanweave.operators import features as ft
from spanweave.operators import reads as rd
from spanweave.operators import tables as tb
from spanweave.plans.prepare import CELLS_SQL
from spanweave.plans.q_features import _CLEAN as DNA
from spanweave.plans.q_features import _ANN as ANN
from spanweave.plans.q_features import _LOCI as LOCI
from spanweave.plans.q_features import _annotation as annotation
from spanweave.plans.q_features import tx
from spanweave.plans.registry import Registry
from spanweave.runtime import load, scratch
from spanweave.sources import binary, logs, sinks, text

R = Registry()


def _written(df: DataFrame, gzip: bool = False) -> str:
    """The folder with the lines of ``df`` (column value)."""
    path = scratch(df.sparkSession, "files")
    sinks.write_lines(df, path, gzip=gzip)
    return path


def _tabs(df: DataFrame, *columns: Column | str) -> DataFrame:
    return df.select(F.concat_ws("\t", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(".")) for c in columns]).alias("value"))


# ---- lines and GTF (S1-S3, S5-S11, K2, K4; commands of S4 are not run) ----
@R.add("file_lines", "SELECT count(*) AS n, count(DISTINCT l) AS n_different, sum(length(l))::BIGINT AS n_chars FROM (SELECT rtrim(line, chr(13)) AS l FROM raw_lines) WHERE l <> ''")
def file_lines(spark: SparkSession, d: str) -> DataFrame:
    path = _written(load(spark, d, "raw_lines").where("line IS NOT NULL").select(F.col("line").alias("value")), gzip=True)
    return text.stream_of(spark, "file", path).agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_different"), F.sum(F.length("value")).alias("n_chars"))


@R.add("held_lines", "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS pos, n_name AS value FROM nation")
def held_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = [r.n_name + "\n" for r in load(spark, d, "nation").orderBy("n_nationkey").collect()]  # a fixed table of 25 rows stands for standard input
    return text.stream_of(spark, "stdin", rows).select(F.col("_pos").alias("pos"), "value")


def _gtf_file(spark: SparkSession, d: str) -> str:
    g = load(spark, d, "gtf").where("attributes IS NOT NULL")
    rows = _tabs(g, "seqname", "record_id", "feature", "start", "end", "score", "strand", "frame", "attributes")
    return _written(spark.createDataFrame([("# head",), ("#!x\t1",)], "value string").unionByName(rows))


@R.add("gtf_file", """SELECT record_id, coalesce(seqname, '.') AS chrom, feature, start, "end", coalesce(score, '.') AS score, coalesce(strand, '.') AS strand, coalesce(frame, '.') AS frame, attributes
FROM gtf WHERE attributes IS NOT NULL""")
def gtf_file(spark: SparkSession, d: str) -> DataFrame:
    return text.gtf(spark, _gtf_file(spark, d)).select(F.col("source").cast("bigint").alias("record_id"), "chrom", "feature", "start", "end", "score", "strand", "frame", "attributes")


_WRITTEN = (CELLS_SQL % "true").split("q AS (SELECT record_id, pos, lower(k)")[0] + r"""q AS (SELECT record_id, pos, k, trim(regexp_replace(v, '\s*;$', '')) AS v FROM p),
n AS (SELECT record_id, k, pos, trim(CASE WHEN length(v) > 1 AND v[1] IN ('"', chr(39)) AND v[-1] = v[1] THEN v[2:-2] ELSE v END) AS v FROM q),
m AS (SELECT record_id, k, string_agg(v, ',' ORDER BY pos) AS v FROM n GROUP BY record_id, k),
w AS (SELECT record_id, """ + ", ".join(f"max(CASE WHEN k = '{k}' THEN v END) AS {k}" for k in ("gene_id", "transcript_id", "gene", "gene_name", "gene_type", "gene_biotype", "transcript_type", "transcript_biotype")) + " FROM m GROUP BY record_id) "  # fmt: skip


@R.add("gtf_attribute_map", _WRITTEN + "SELECT record_id, k AS key, v AS value FROM m")
def gtf_attribute_map(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "gtf").select("record_id", F.explode(attribute_map(F.col("attributes"))).alias("key", "value"))


@R.add("gtf_getters", _WRITTEN + """SELECT g.record_id, gene_id, coalesce(transcript_id, gene_id) AS transcript_id, coalesce(gene, gene_name, gene_id) AS gene_name,
 coalesce(gene_type, gene_biotype) AS gene_type, coalesce(transcript_type, transcript_biotype) AS transcript_type FROM gtf g LEFT JOIN w ON g.record_id = w.record_id WHERE attributes IS NOT NULL""")
def gtf_getters(spark: SparkSession, d: str) -> DataFrame:
    return text.gtf(spark, _gtf_file(spark, d)).select(F.col("source").cast("bigint").alias("record_id"), "gene_id", "transcript_id", "gene_name", "gene_type", "transcript_type")


# ---- BED (S12, S13, S29, K10, K11) ----
@R.add("bed6_file", """SELECT interval_id::VARCHAR AS name, coalesce(chrom, '.') AS chrom, start, "end", coalesce(score, '.') AS score, coalesce(strand, '.') AS strand FROM bed6""")
def bed6_file(spark: SparkSession, d: str) -> DataFrame:
    path = _written(_tabs(load(spark, d, "bed6"), "chrom", "start", "end", "interval_id", "score", "strand"))
    return text.bed6(spark, path).select("name", "chrom", "start", "end", "score", "strand")


@R.add("bed12_file", """SELECT bed_id::VARCHAR AS name, chrom, start, "end", coalesce(score, 'None') AS score, coalesce(strand, 'None') AS strand, "thickStart", "thickEnd", "itemRgb"::BIGINT AS "itemRgb", "blockCount"::BIGINT AS "blockCount",
 coalesce("blockSizes", 'None') AS "blockSizes", coalesce("blockStarts", 'None') AS "blockStarts" FROM bed12 WHERE coalesce(regexp_matches("blockSizes" || "blockStarts", '[\t\r\n]'), false) = false""")
def bed12_file(spark: SparkSession, d: str) -> DataFrame:
    b = load(spark, d, "bed12").where(~F.coalesce(F.concat("blockSizes", "blockStarts").rlike("[\t\r\n]"), F.lit(False)))  # as the SQL: a row where either is null stays, whatever the other holds
    cols = ["chrom", "start", "end", "bed_id", "score", "strand", "thickStart", "thickEnd", "itemRgb", "blockCount", "blockSizes", "blockStarts"]
    back = text.bed12(spark, _written(sinks.row_text(b, cols, escape=True)), escaped=True).drop("path", "blocks")
    return back.withColumns({c: F.coalesce(c, F.lit("None")) for c in ("score", "strand", "blockSizes", "blockStarts")})


@R.add("bed_loci", """SELECT interval_id::VARCHAR AS id, chrom, start, "end", CASE WHEN strand = '-' THEN '-' ELSE '+' END AS strand, 50000 AS before, 50000 AS after FROM bed6 WHERE chrom IS NOT NULL""")
def bed_loci(spark: SparkSession, d: str) -> DataFrame:
    path = _written(_tabs(load(spark, d, "bed6").where("chrom IS NOT NULL"), "chrom", "start", "end", "interval_id", "score", "strand"))
    return text.bed_loci(text.bed6(spark, path))


@R.add("loci_bed", f"""WITH {LOCI}, x AS (SELECT chrom, strand, min(start) AS start, max("end") AS "end", string_agg(DISTINCT gene_name, ',' ORDER BY gene_name) AS name, count(*)::VARCHAR AS score FROM r GROUP BY chrom, strand, run)
SELECT chrom, start, "end", coalesce(name, '') AS name, score, strand FROM x""")
def loci_bed(spark: SparkSession, d: str) -> DataFrame:
    return text.bed6(spark, _written(sinks.row_text(sinks.loci_bed(ft.loci(tx(spark, d)))))).drop("path")


# ---- FASTA and FASTQ (S20, S23, S24, K6-K8, C3, C4, C7, C12, F21, J13, J14, P7) ----
def _letters(spark: SparkSession, d: str) -> DataFrame:
    """Documents as sequences."""
    return load(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("name"), F.col("source").alias("comment"), sq.to_dna(F.col("text")).alias("sequence"))


_LETTERS = f"l AS (SELECT doc_id::VARCHAR AS name, {DNA} AS sequence FROM documents WHERE text IS NOT NULL)"


@R.add("fasta_file", f"WITH {_LETTERS} SELECT name, sequence FROM l")
def fasta_file(spark: SparkSession, d: str) -> DataFrame:
    return text.fasta(spark, _written(sinks.fasta_text(_letters(spark, d), 60))).select("name", "sequence")


@R.add("wrap_lines", f"WITH {_LETTERS} SELECT name, list_transform(range(0, length(sequence), 60), lambda i: sequence[i + 1 : i + 60]) AS lines FROM l WHERE sequence <> ''")
def wrap_lines(spark: SparkSession, d: str) -> DataFrame:
    return _letters(spark, d).where("sequence <> ''").select("name", F.split(sq.wrap(F.col("sequence"), 60), "\n").alias("lines"))


@R.add("fasta_lengths", f"WITH {_LETTERS} SELECT name, length(sequence) AS length FROM l")
def fasta_lengths(spark: SparkSession, d: str) -> DataFrame:
    return text.chrom_lengths(text.fasta(spark, _written(sinks.fasta_text(_letters(spark, d)))))


@R.add("fasta_choose", f"WITH {_LETTERS} SELECT name FROM l WHERE regexp_matches(name, '7$')")
def fasta_choose(spark: SparkSession, d: str) -> DataFrame:
    return sinks.choose_records(_letters(spark, d), ["7$"]).select("name")


@R.add("fasta_u2t", "SELECT doc_id, translate(text, 'Uu', 'Tt') AS t FROM documents")
def fasta_u2t(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", sq.u_to_t(F.col("text")).alias("t"))


def _fastq(spark: SparkSession, d: str) -> DataFrame:
    return text.fastq(spark, _written(sinks.fastq_text(_letters(spark, d))))


@R.add("fastq_file", f"WITH {_LETTERS} SELECT name, sequence, repeat('F', length(sequence)) AS quality FROM l")
def fastq_file(spark: SparkSession, d: str) -> DataFrame:
    return _fastq(spark, d).select("name", "sequence", "quality")


@R.add("fastq_to_fasta", f"WITH {_LETTERS} SELECT name, sequence FROM l")
def fastq_to_fasta(spark: SparkSession, d: str) -> DataFrame:
    return text.fasta(spark, _written(sinks.fasta_text(_fastq(spark, d)))).select("name", "sequence")


@R.add("fastq_pairs", f"WITH {_LETTERS} SELECT name, sequence, reverse(translate(replace(sequence, 'Z', ''), 'ACGTNWSKMYRHBVD', 'TGCANWSMKRYDVBH')) AS sequence_2 FROM l")
def fastq_pairs(spark: SparkSession, d: str) -> DataFrame:
    one = _letters(spark, d).coalesce(1).sortWithinPartitions("name").drop("comment")  # pairs of files stand in one order
    two = one.withColumn("sequence", sq.reverse_complement(F.replace("sequence", F.lit("Z"), F.lit("")), False))
    got = rd.zip_pairs(*[text.fastq(spark, _written(sinks.fastq_text(x.withColumn("name", F.concat("name", F.lit(f"/{i}")))))) .drop("path") for i, x in ((1, one), (2, two))])
    return got.select(F.substring_index("name", "/", 1).alias("name"), "sequence", "sequence_2")


@R.add("fastq_join", f"""WITH {_LETTERS}, z AS (SELECT name, replace(sequence, 'Z', '') AS s FROM l) SELECT name || '_R1' AS name, s AS sequence FROM z
UNION ALL SELECT name || '_R2', reverse(translate(s, 'ACGTNWSKMYRHBVD', 'TGCANWSMKRYDVBH')) FROM z""")
def fastq_join(spark: SparkSession, d: str) -> DataFrame:
    read = F.struct(F.replace("sequence", F.lit("Z"), F.lit("")).alias("sequence"), F.lit("").alias("quality"))
    return rd.join_mates_fastq(_letters(spark, d).select("name", read.alias("r1"), read.alias("r2"))).select("name", "sequence")


@R.add("fetch_regions", f"""WITH {_LETTERS} SELECT interval_id, CASE WHEN strand = '-' THEN reverse(translate(s, 'ACGTNWSKMYRHBVD', 'TGCANWSMKRYDVBH')) ELSE s END AS sequence FROM (
 SELECT interval_id, strand, substr(sequence, (start % 100 + 1)::BIGINT, greatest(least("end" - start, length(sequence) - start % 100), 0)) AS s FROM bed6 JOIN l ON interval_id::VARCHAR = l.name WHERE "end" > start)""")
def fetch_regions(spark: SparkSession, d: str) -> DataFrame:
    b = load(spark, d, "bed6").where("end > start").select("interval_id", F.col("interval_id").cast("string").alias("name"), (F.col("start") % 100).alias("s"), (F.col("start") % 100 + F.col("end") - F.col("start")).alias("e"), "strand")
    return b.join(_letters(spark, d), "name").select("interval_id", sq.fetch(F.col("sequence"), F.col("s"), F.col("e"), F.col("strand")).alias("sequence"))


@R.add("fetch_blocks", f"""WITH {_LETTERS} SELECT name, sequence[1:10] || sequence[21:30] AS sequence FROM l""")
def fetch_blocks(spark: SparkSession, d: str) -> DataFrame:
    blocks = F.array(bl.block(F.lit(0), F.lit(10)), bl.block(F.lit(20), F.lit(30)))
    return _letters(spark, d).select("name", sq.fetch_blocks(F.col("sequence"), blocks).alias("sequence"))


# ---- alignments (S14-S19, K9, K14, C4, C5, F7, F8, F11) ----
def _alignments(spark: SparkSession, d: str) -> DataFrame:
    """Rows of bed6 as alignments: the flag from the low bits of the id, a gap where the interval is long."""
    b = load(spark, d, "bed6").where("chrom IS NOT NULL AND start IS NOT NULL AND end > start")
    n = F.col("end") - F.col("start")
    cigar = F.when(n > 100, F.concat(F.lit("40M"), (n - 100).cast("string"), F.lit("N3I60M"))).otherwise(F.concat(n.cast("string"), F.lit("M")))
    return b.select(
        F.col("interval_id").alias("_pos"), F.concat(F.lit("q"), F.col("interval_id").cast("string")).alias("qname"), F.col("interval_id").bitwiseAND(F.lit(4095)).cast("int").alias("flag"), F.col("chrom").alias("rname"),
        F.col("start").alias("pos"), F.when(F.col("score").rlike("^[0-9]+$"), F.col("score").cast("int") % 61).otherwise(0).alias("mapq"), cigar.alias("cigar"), F.lit("ACGT").alias("seq"), F.lit("IIII").alias("qual"),
    )


_AL = """al AS (SELECT interval_id, 'q' || interval_id AS qname, (interval_id & 4095)::INTEGER AS flag, chrom AS rname, start AS pos, CASE WHEN regexp_full_match(score, '[0-9]+') THEN score::INTEGER % 61 ELSE 0 END AS mapq,
 CASE WHEN "end" - start > 100 THEN '40M' || ("end" - start - 100) || 'N3I60M' ELSE ("end" - start) || 'M' END AS cigar, 'ACGT' AS seq, 'IIII' AS qual, start, "end" FROM bed6 WHERE chrom IS NOT NULL AND start IS NOT NULL AND "end" > start)"""
_FIELDS = ["qname", "flag", "rname", "pos", "mapq", "cigar", "seq", "qual"]


@R.add("sam_file", f"WITH {_AL} SELECT {', '.join(_FIELDS)} FROM al")
def sam_file(spark: SparkSession, d: str) -> DataFrame:
    return text.sam(spark, _written(sinks.sam_text(_alignments(spark, d)))).select(*_FIELDS)


@R.add("bam_file", f"WITH {_AL} SELECT {', '.join(_FIELDS)} FROM al")
def bam_file(spark: SparkSession, d: str) -> DataFrame:
    al = _alignments(spark, d)
    refs = al.groupBy("rname").agg((F.max("pos") + (1 << 20)).alias("n")).orderBy("rname").collect()  # the references of a header, one row each
    path = scratch(spark, "bam")
    binary.write_bam(al, path, [tuple(r) for r in refs])
    return spark.read.format("spanweave_bam").load(path).select(*_FIELDS)


def _kept(name: str, sql: str, f) -> None:
    def q(spark: SparkSession, d: str) -> DataFrame:
        return f(_alignments(spark, d)).select("qname")

    R.add(name, f"WITH {_AL} SELECT qname FROM al WHERE {sql}")(q)


_kept("bam_usable", "flag & 1796 = 0", rd.usable)
_kept("bam_mapped", "flag & 3844 = 0 AND mapq >= 30", lambda df: rd.mapped(df, least_mapq=30))
_kept("bam_unmapped", "flag & 4 <> 0 AND flag & 2816 = 0", rd.unmapped)
_kept("bam_by_flags", "flag & 2308 = 0 AND flag IN (0, 16, 83, 99, 1) AND flag NOT IN (1)", lambda df: rd.by_flags(df, [0, 16, 83, 99, 1], [1]))


@R.add("bam_type", f"WITH {_AL} SELECT CASE WHEN flag & 192 <> 0 THEN 'PE' ELSE 'SE' END AS kind FROM al ORDER BY interval_id LIMIT 1")
def bam_type(spark: SparkSession, d: str) -> DataFrame:
    return rd.bam_type(_alignments(spark, d))


@R.add("cigar_blocks", f"""WITH {_AL} SELECT qname, CASE WHEN "end" - start > 100 THEN start || '-' || (start + 40) || ',' || ("end" - 60) || '-' || "end" ELSE start || '-' || "end" END AS blocks FROM al""")
def cigar_blocks(spark: SparkSession, d: str) -> DataFrame:
    got = rd.with_blocks(_alignments(spark, d))
    return got.select("qname", F.array_join(F.transform("blocks", lambda b: F.concat_ws("-", b["start"].cast("string"), b["end"].cast("string"))), ",").alias("blocks"))


@R.add("bam_to_fastx", f"WITH {_AL} SELECT qname AS name, CASE WHEN flag & 16 <> 0 THEN 'ACGT' ELSE seq END AS sequence, reverse(qual) AS quality FROM al")
def bam_to_fastx(spark: SparkSession, d: str) -> DataFrame:
    return rd.to_fastx(_alignments(spark, d))


@R.add("fragment_strand", """SELECT interval_id, CASE WHEN strand NOT IN ('+', '-') OR strand IS NULL THEN CASE WHEN interval_id & 128 <> 0 THEN '+' END WHEN (interval_id & 128 <> 0) <> (strand = '+') THEN '-' ELSE '+' END AS flipped,
 CASE WHEN strand NOT IN ('+', '-') OR strand IS NULL THEN CASE WHEN interval_id & 128 <> 0 THEN '+' END WHEN (interval_id & 128 <> 0) = (strand = '+') THEN '-' ELSE '+' END AS kept FROM bed6""")
def fragment_strand(spark: SparkSession, d: str) -> DataFrame:
    second = F.col("interval_id").bitwiseAND(F.lit(128)) != 0
    return load(spark, d, "bed6").select("interval_id", bl.fragment_strand(F.col("strand"), "1+-,1-+,2++,2--", second).alias("flipped"), bl.fragment_strand(F.col("strand"), "1++,1--,2+-,2-+", second).alias("kept"))


# ---- tracks and tables (S25-S28, S30, S31, K3, K5, K12, K13, K15) ----
@R.add("bedgraph_file", """WITH e AS (SELECT chrom, p, sum(d) AS d FROM (SELECT chrom, start AS p, 1 AS d FROM bed6 WHERE "end" > start AND chrom IS NOT NULL UNION ALL SELECT chrom, "end", -1 FROM bed6 WHERE "end" > start AND chrom IS NOT NULL) GROUP BY 1, 2 HAVING sum(d) <> 0),
t AS (SELECT chrom, p AS start, lead(p) OVER w AS "end", sum(d) OVER w AS v FROM e WINDOW w AS (PARTITION BY chrom ORDER BY p)) SELECT chrom, start, "end", v::DOUBLE AS value FROM t WHERE v > 0""")
def bedgraph_file(spark: SparkSession, d: str) -> DataFrame:
    from spanweave.operators.intervals import depth

    runs = depth(load(spark, d, "bed6").select("chrom", "start", "end"), ["chrom"])
    return text.bedgraph(spark, _written(_tabs(runs, "chrom", "start", "end", "depth"))).drop("sample")


@R.add("table_file", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def table_file(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").drop("o_orderdate")
    path = scratch(spark, "table") + ".csv"
    sinks.write_table(o, path)
    return text.table(spark, path, schema=o.schema)


@R.add("chrom_sizes_file", 'SELECT seqname AS chrom, max("end") AS length FROM gtf WHERE seqname IS NOT NULL GROUP BY 1')
def chrom_sizes_file(spark: SparkSession, d: str) -> DataFrame:
    return text.chrom_sizes(spark, _written(_tabs(load(spark, d, "gtf").where("seqname IS NOT NULL").groupBy("seqname").agg(F.max("end").alias("n")), "seqname", "n")))


@R.add("name_list_file", "SELECT unnest(regexp_split_to_array(trim(gene_name), '\\s+')) AS name FROM trans_info WHERE trim(gene_name) <> ''")
def name_list_file(spark: SparkSession, d: str) -> DataFrame:
    return text.name_list(spark, _written(load(spark, d, "trans_info").where("gene_name IS NOT NULL").select(F.col("gene_name").alias("value"))))


@R.add("feature_counts_file", """SELECT l_partkey AS "Gene", p_size AS "Length", count(*) AS s1 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
def feature_counts_file(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n")).join(load(spark, d, "part").select("p_partkey", "p_size"), "p_partkey")
    rows = _tabs(n, "p_partkey", F.lit("c"), F.lit(1), F.lit(2), F.lit("+"), "p_size", "n").withColumn("_k", F.lit(1))
    head = spark.createDataFrame([("# a program", 0), ("Geneid\tChr\tStart\tEnd\tStrand\tLength\t/p/s1.sorted.bam", 0)], "value string, _k int").coalesce(1)
    path = scratch(spark, "files")
    sinks.write_lines(head.unionByName(rows).coalesce(1).sortWithinPartitions("_k"), path)  # the header stands ahead of the rows in one file, as the program writes it
    got = text.feature_counts(spark, path)
    return got.select(F.col("Gene").cast("bigint").alias("Gene"), F.col("Length").cast("int").alias("Length"), F.col("s1").cast("bigint").alias("s1"))


@R.add("gene_model_file", f"WITH {LOCI} SELECT chrom, strand, start, \"end\", count FROM l")
def gene_model_file(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "model")
    sinks.gene_model(ft.loci(tx(spark, d)), path)
    return text.gene_model(spark, path).select("chrom", "strand", "start", "end", "count")


@R.add("matrix_file", "SELECT event_type AS sample, (user_id % 10)::INTEGER AS bin, round(avg(value), 6) AS value FROM events GROUP BY 1, 2")
def matrix_file(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "matrix")
    means = load(spark, d, "events").groupBy(F.col("event_type").alias("sample"), (F.col("user_id") % 10).cast("int").alias("bin")).agg(F.round(F.avg("value"), 6).alias("value"))
    sinks.profile_matrix(means, path)
    return spark.read.parquet(path)


@R.add("tee_lines", "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1")
def tee_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.tee(load(spark, d, "orders").select(F.col("o_orderpriority").alias("value")), scratch(spark, "files")).groupBy("value").agg(F.count("*").alias("n"))


@R.add("collectors", """SELECT n_regionkey, list_sort(list(n_name)) AS names, list_sort(list(DISTINCT n_nationkey)) AS keys, map_from_entries(list((n_nationkey, n_name) ORDER BY n_nationkey))[min(n_nationkey)] AS first FROM nation GROUP BY 1""")
def collectors(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "nation")
    got = n.groupBy("n_regionkey").agg(sinks.collected(n, "n_name").alias("a"), sinks.collected(n, "n_nationkey", "set").alias("b"), sinks.collected(n, "n_name", "dict", "n_nationkey").alias("m"), F.min("n_nationkey").alias("k"))
    return got.select("n_regionkey", F.array_sort("a").alias("names"), F.array_sort("b").alias("keys"), F.col("m")[F.col("k")].alias("first"))


# ---- logs (S32, F22-F24, J21): a log of each tool for each nation, made of its customers' and suppliers' numbers ----
def _numbers(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("a"))
    s = load(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("b"))
    n = load(spark, d, "nation").join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").na.fill(0, ["a", "b"])
    return n.withColumn("path", F.concat(F.lit("file:/logs/"), F.lower("n_name"), F.lit("_rep"), (F.col("n_regionkey") % 3).cast("string"), F.lit(".x.log")))


_NUM = """num AS (SELECT lower(n_name) || '_rep' || (n_regionkey % 3) AS samples, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS a, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS b FROM nation)"""
_LOGS = {
    "cutadapt": ("This is a log\nTotal read pairs processed:  %1$d\n  Read 1 with adapter:   %2$d (10.5%%)\n  Read 2 with adapter:   %1$d (9.0%%)\n", logs.cutadapt,
                 "a::VARCHAR AS total_read_pairs, b::VARCHAR AS read1_with_adapter, '10.5%' AS read1_with_adapter_percent, a::VARCHAR AS read2_with_adapter, '9.0%' AS read2_with_adapter_percent"),
    "fastp": ("Read1 before filtering:\ntotal reads: %1$d\ntotal bases: 5\nRead2 before filtering:\ntotal reads: %1$d\nRead1 after filtering:\ntotal reads: %2$d\n", logs.fastp,
              "a::VARCHAR AS total_read_pairs, b::VARCHAR AS qc_read_pairs"),
    "bowtie2": ("%1$d reads; of these:\n  %1$d (100%%) were paired; of these:\n    3 (1%%) aligned 0 times\n    %1$d (30%%) aligned exactly 1 time\n    %2$d (2%%) aligned >1 times\n87.50%% overall alignment rate\n", logs.bowtie2,
                "a::VARCHAR AS input_read_pairs, (a + b)::VARCHAR AS mapped_read_pairs, '87.50%' AS alignment_rate"),
    "hisat2": ("%1$d reads; of these:\nx\n0 a\n%1$d b\n%2$d c\n----\nx\n%2$d d\n----\nx\nx\nx\n%1$d e\n%2$d f\n88.00%% overall alignment rate\n", logs.hisat2,
               "a::VARCHAR AS input_read_pairs, (2 * a + 3 * b)::VARCHAR AS mapped_read_pairs, '88.00%' AS alignment_rate"),
    "star": (" Number of input reads |\t%1$d\n Uniquely mapped reads number |\t%2$d\n Uniquely mapped reads %% |\t50.25%%\n Number of reads mapped to multiple loci |\t%1$d\n %% of reads mapped to multiple loci |\t20.50%%\n", logs.star,
             "a::VARCHAR AS input_read_pairs, b::VARCHAR AS unique_mapped, '50.25%' AS unique_rate, a::VARCHAR AS multiple_mapped, '20.50%' AS multiple_rate, (a + b)::VARCHAR AS mapped_read_pairs, '70.75%' AS alignment_rate"),
    "picard": ("## METRICS\nLIBRARY\tX\nUnknown Library\t1\t0.125\t%1$d\n", logs.picard_duplicates, "'12.50%' AS duplication_rate, a::VARCHAR AS estimated_librarysize"),
    "flagstat": ("%2$d + 0 in total\n%1$d + 0 properly paired (80%%)\n", logs.flagstat, "(a // 2)::VARCHAR AS filtered_read_pairs"),
}


def _log(spark: SparkSession, d: str, tool: str) -> DataFrame:
    form, parse, _ = _LOGS[tool]
    return parse(_numbers(spark, d).select("path", F.format_string(form, F.col("a"), F.col("b")).alias("content")))


for _tool, (_, _, _want) in _LOGS.items():

    def _log_query(spark: SparkSession, d: str, tool: str = _tool) -> DataFrame:
        return _log(spark, d, tool)

    R.add(f"log_{_tool}", f"WITH {_NUM} SELECT samples, {_want} FROM num")(_log_query)


@R.add("log_summary", f"WITH {_NUM} SELECT samples, a::VARCHAR AS total_read_pairs, b::VARCHAR AS qc_read_pairs, a::VARCHAR AS input_read_pairs, (a + b)::VARCHAR AS mapped_read_pairs, 'rep' || right(samples, 1) AS replicates, regexp_replace(samples, '_rep.$', '') AS \"group\" FROM num")
def log_summary(spark: SparkSession, d: str) -> DataFrame:
    return logs.summary([_log(spark, d, "fastp"), _log(spark, d, "bowtie2").drop("alignment_rate")])


# ---- functions and operators of rows (F10, F13, F15, F20, F25, A6, A26, I8, P12) ----
@R.add("runs_of_one", """WITH k AS (SELECT user_id, v, v - row_number() OVER (PARTITION BY user_id ORDER BY v) AS g FROM (SELECT DISTINCT user_id, event_id // 40 AS v FROM events)),
r AS (SELECT user_id, list(v ORDER BY v) AS run FROM k GROUP BY user_id, g) SELECT user_id, list(run ORDER BY run[1]) AS runs FROM r GROUP BY user_id""")
def runs_of_one(spark: SparkSession, d: str) -> DataFrame:
    v = load(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set(F.expr("event_id div 40"))).alias("v"))
    return v.select("user_id", bl.runs_of_one(F.col("v")).alias("runs"))


@R.add("distances_by_strand", """SELECT interval_id, CASE WHEN strand = '-' THEN "end" ELSE start END AS up, CASE WHEN strand = '-' THEN start ELSE "end" END AS down FROM bed6""")
def distances_by_strand(spark: SparkSession, d: str) -> DataFrame:
    up, down = bl.by_strand(F.col("start"), F.col("end"), F.col("strand"))
    return load(spark, d, "bed6").select("interval_id", up.alias("up"), down.alias("down"))


@R.add("codons", f"""WITH {LOCI.partition(', m AS (')[0]} SELECT transcript_id, CASE WHEN strand = '-' THEN cds_end - 3 ELSE cds_start END AS start_at, CASE WHEN strand = '-' THEN cds_start ELSE cds_end - 3 END AS stop_at FROM t WHERE cds_start IS NOT NULL""")
def codons(spark: SparkSession, d: str) -> DataFrame:
    args = (F.col("cds_start"), F.col("cds_end"), F.col("strand"))
    return tx(spark, d).where("cds_start IS NOT NULL").select("transcript_id", bl.start_codon(*args)["start"].alias("start_at"), bl.stop_codon(*args)["start"].alias("stop_at"))


@R.add("locations", """SELECT interval_id, chrom, start, "end", CASE WHEN strand IN ('+', '-') THEN strand END AS strand FROM bed6 WHERE chrom IS NOT NULL AND start IS NOT NULL AND "end" IS NOT NULL""")
def locations(spark: SparkSession, d: str) -> DataFrame:
    b = load(spark, d, "bed6").where("chrom IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL")
    strand = F.when(F.col("strand").isin("+", "-"), F.concat(F.lit("("), "strand", F.lit(")"))).otherwise("")
    return b.select("interval_id", sq.location(F.concat("chrom", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), strand)).alias("x")).select("interval_id", "x.*")


@R.add("spike_ins", """SELECT s_name AS seqname, f AS feature, 1::BIGINT AS start, length(s_name) AS "end", 'gene_id "' || s_name || '";' || CASE WHEN f = 'gene' THEN '' ELSE ' transcript_id "' || s_name || '";' END AS attributes
FROM supplier, (VALUES ('gene'), ('transcript'), ('exon')) v(f)""")
def spike_ins(spark: SparkSession, d: str) -> DataFrame:
    _, rows = rd.spike_ins(load(spark, d, "supplier").select(F.col("s_name").alias("ERCC_ID"), F.concat(F.lit(" "), "s_name").alias("Sequence")))
    return rows.select("seqname", "feature", "start", "end", "attributes")


@R.add("non_numeric", "SELECT record_id, TRY_CAST(score AS DOUBLE) IS NULL AS bad FROM gtf WHERE score IS NOT NULL")
def non_numeric(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "gtf").where("score IS NOT NULL").select("record_id", tb.non_numeric("score").alias("bad"))


@R.add("percent", "SELECT o_orderkey, round(o_totalprice / 1000, 1) AS share FROM orders")
def percent(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select("o_orderkey", tb.percent(F.concat(F.round(F.col("o_totalprice") / 1000, 1).cast("string"), F.lit("%"))).alias("share"))


@R.add("loci_without", f"""WITH {LOCI.replace("WHERE chrom IS NOT NULL AND strand IS NOT NULL", "WHERE chrom IS NOT NULL AND strand IS NOT NULL AND coalesce(gene_type NOT IN ('lncRNA', 'snoRNA'), true) AND NOT coalesce(starts_with(gene_name, 'G'), false)", 1)} SELECT chrom, strand, start, "end", transcript_id, count FROM l""")
def loci_without(spark: SparkSession, d: str) -> DataFrame:
    return ft.loci(tx(spark, d), drop_types=["lncRNA", "snoRNA"], drop_names=["G"]).select("chrom", "strand", "start", "end", "transcript_id", "count")


@R.add("annotate_alignments", f"""WITH {ANN}, {_AL}, r AS (SELECT interval_id FROM al WHERE flag & 3844 = 0),
s AS (SELECT id, list_filter([{', '.join(f"'{x}'" for x in an.PRIORITY)}], lambda p: list_contains(list(prim), p))[1] AS anno FROM be WHERE tier = best GROUP BY id)
SELECT interval_id AS id, coalesce(anno, 'Intergenic') AS anno FROM r LEFT JOIN s ON interval_id = id""")
def annotate_alignments(spark: SparkSession, d: str) -> DataFrame:
    reads = _alignments(spark, d).withColumn("cigar", F.translate("cigar", "N", "D"))  # one block each, as wide as the interval
    return an.annotate_alignments(reads, annotation(spark, d)[1]).select("id", "anno")


@R.add("annotate_fragments")
def annotate_fragments(spark: SparkSession, d: str) -> DataFrame:
    return an.annotate_alignments(_alignments(spark, d).withColumn("qname", F.concat_ws(":", "rname", F.expr("pos div 500").cast("string"))), annotation(spark, d)[1], paired=True).select("id", "qname", "strand", "anno")
