"""Text sources (S1-S13, S20-S31): lines, GTF, BED, FASTA, FASTQ, SAM, bedGraph, tables and name lists as typed frames.

Parsing is by built-in expressions over ``read.text``; gzip files are read by their suffix. Malformed lines follow the formats' lenient rules here; to set them apart
with a reason, use ``spanweave.operators.badrows``. Coordinates of BED and SAM frames are 0-based; GTF frames keep 1-based closed ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanweave.functions.attributes import attribute_map
from spanweave.functions.blocks import bed12_blocks
from spanweave.sources.sinks import ESCAPES, NONE_TEXT

Paths = str | list[str]


def lines(spark: SparkSession, paths: Paths, whole: bool = False) -> DataFrame:
    """(path, value) of the lines that are not empty, without line ends; ``whole`` keeps empty ones."""
    out = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"[\r\n]+\z", "").alias("value"))
    return out if whole else out.where(F.col("value") != "")


def from_lines(spark: SparkSession, rows: list[str]) -> DataFrame:
    """Lines that the driver already holds (standard input), with their order."""
    return spark.createDataFrame([(i, x.rstrip("\r\n")) for i, x in enumerate(rows)], "_pos bigint, value string")


def stream_of(spark: SparkSession, kind: str, source: Paths | list[str]) -> DataFrame:
    """``file`` or ``stdin``; other commands are not run."""
    if kind == "file":
        return lines(spark, source)
    if kind == "stdin":
        return from_lines(spark, list(source))
    raise ValueError(f"unsupported kind {kind}: commands are not run")


# ---- GTF ----
def attribute(attributes: Column, name: str) -> Column:
    """One attribute as written, several values joined by commas, null where it is absent or empty."""
    return F.nullif(attribute_map(attributes)[name], F.lit(""))


def getters(attrs: Column) -> dict[str, Column]:
    """Ids, names and types with their fallbacks; of gene_name and gene the latter wins."""
    gene = F.coalesce(attrs["gene"], attrs["gene_name"], attrs["gene_id"])
    return {
        "gene_id": attrs["gene_id"], "transcript_id": F.coalesce(attrs["transcript_id"], attrs["gene_id"]), "gene_name": gene, "transcript_name": F.coalesce(attrs["transcript_name"], gene),
        "gene_type": F.coalesce(attrs["gene_type"], attrs["gene_biotype"]), "transcript_type": F.coalesce(attrs["transcript_type"], attrs["transcript_biotype"]),
    }


def gtf(spark: SparkSession, paths: Paths, comment: str = "#", features: list[str] | None = None) -> DataFrame:
    """Nine columns, ``attrs`` and the getters' columns. Comments are dropped anywhere; ``features`` are filtered before attributes are parsed."""
    f = F.split("value", "\t", -1)
    names = "chrom source feature start end score strand frame attributes".split()
    rows = lines(spark, paths).where(~F.col("value").startswith(comment)).withColumn("_f", f).where(F.size("_f") >= 9)
    if features:
        rows = rows.where(F.get("_f", F.lit(2)).isin(features))
    cols = [(F.expr(f"try_cast(_f[{i}] AS BIGINT)") if n in ("start", "end") else F.get("_f", F.lit(i))).alias(n) for i, n in enumerate(names)]
    rows = rows.select("path", *cols).withColumn("attrs", attribute_map(F.col("attributes")))
    return rows.withColumns(getters(F.col("attrs")))


def filter_features(df: DataFrame, features: list[str] | None = None, **lists: list[str]) -> DataFrame:
    """Rows of the features whose columns (gene_type, transcript_id, ...) lie in the lists given; after the getters' fallbacks."""
    conds = [F.col("feature").isin(features)] if features else []
    conds += [F.col(c).isin(some) for c, some in lists.items() if some]
    return df.where(reduce(lambda a, b: a & b, conds)) if conds else df


# ---- BED ----
def unescaped(field: Column) -> Column:
    """The text of a field that ``sinks.row_text`` wrote with ``escape``; ``None`` is null."""
    out = F.nullif(field, F.lit("None"))
    for sign, code in (("N", NONE_TEXT[:3]), *reversed(ESCAPES)):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return out


def _bed(spark: SparkSession, paths: Paths, names: list[str], whole: set[str], escaped: bool = False) -> DataFrame:
    rows = lines(spark, paths).withColumn("_f", F.split("value", "\t", -1))
    cols = []
    for i, n in enumerate(names):
        x = F.coalesce(F.get("_f", F.lit(i)), F.lit(""))
        cols.append((F.expr(f"try_cast(get(_f, {i}) AS BIGINT)") if n in whole else unescaped(x) if escaped else x).alias(n))
    return rows.select("path", *cols)


_BED6 = "chrom start end name score strand".split()
_BED12 = [*_BED6, *"thickStart thickEnd itemRgb blockCount blockSizes blockStarts".split()]


def bed6(spark: SparkSession, paths: Paths) -> DataFrame:
    """Missing columns are empty, further ones are cut, an empty strand is ``+``; rows without whole start and end keep nulls there."""
    return _bed(spark, paths, _BED6, {"start", "end"}).withColumn("strand", F.when(F.col("strand") == "", "+").otherwise(F.col("strand")))


def bed12(spark: SparkSession, paths: Paths, escaped: bool = False) -> DataFrame:
    """With ``blocks``, the absolute exons. ``escaped`` fields (see ``sinks.row_text``) come back as they were, an empty strand too."""
    df = _bed(spark, paths, _BED12, {"start", "end", "thickStart", "thickEnd", "itemRgb", "blockCount"}, escaped)
    if not escaped:
        df = df.withColumn("strand", F.when(F.col("strand") == "", "+").otherwise(F.col("strand")))
    return df.withColumn("blocks", bed12_blocks(F.col("start"), F.col("blockSizes"), F.col("blockStarts")))


def bed_loci(df: DataFrame, flank: int = 50_000) -> DataFrame:
    """BED6 rows as loci with fixed distances; any strand but ``-`` is ``+``."""
    return df.select("chrom", "start", "end", F.col("name").alias("id"), F.when(F.col("strand") == "-", "-").otherwise("+").alias("strand"), F.lit(flank).alias("before"), F.lit(flank).alias("after"))


# ---- sequences ----
def fasta(spark: SparkSession, paths: Paths) -> DataFrame:
    """(path, name, comment, sequence). Records are read between header signs, so one sequence may span many lines of a splittable file."""
    raw = spark.read.option("lineSep", "\n>").text(paths).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace(F.regexp_replace("value", "^>", ""), "\r", "").alias("v"))
    head, body = F.substring_index("v", "\n", 1), F.regexp_replace(F.expr("substring(v, length(substring_index(v, '\n', 1)) + 1)"), r"\s", "")
    parts = F.split(head, r"\s+", 2)
    return raw.where(F.trim("v") != "").select("path", F.get(parts, F.lit(0)).alias("name"), F.get(parts, F.lit(1)).alias("comment"), body.alias("sequence"))


def fastq(spark: SparkSession, paths: Paths) -> DataFrame:
    """(path, _pos, name, comment, sequence, quality) of four-line records; ``_pos`` counts the records of each file.

    A split's lines come in order within one task, so a line's place is its place in the split plus the lines of the file's earlier splits, one short row each.
    """
    text = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_split"), F.regexp_replace("value", r"[\r\n]+\z", "").alias("value"), F.monotonically_increasing_id().alias("_id"))
    splits = text.groupBy("path", "_split").agg(F.min("_id").alias("_first"), F.count("*").alias("_lines"))
    ahead = F.sum("_lines").over(Window.partitionBy("path").orderBy("_split")) - F.col("_lines")  # a row per split of a file
    rows = text.join(splits.withColumn("_ahead", ahead).drop("_lines"), ["path", "_split"]).withColumn("_n", F.col("_id") - F.col("_first") + F.col("_ahead"))
    rows = rows.select("path", "value", F.expr("_n div 4").alias("_pos"), (F.col("_n") % 4).alias("_k"))
    rec = rows.groupBy("path", "_pos").agg(*[F.max(F.when(F.col("_k") == k, F.col("value"))).alias(f"l{k}") for k in (0, 1, 3)]).where("l1 IS NOT NULL")
    head = F.split(F.regexp_replace("l0", "^@", ""), r"\s+", 2)
    return rec.select("path", "_pos", F.get(head, F.lit(0)).alias("name"), F.get(head, F.lit(1)).alias("comment"), F.col("l1").alias("sequence"), F.col("l3").alias("quality"))


def chrom_lengths(genome: DataFrame) -> DataFrame:
    """C12."""
    return genome.select("name", F.length("sequence").cast("bigint").alias("length"))


# ---- alignments ----
def sam(spark: SparkSession, paths: Paths) -> DataFrame:
    """S19, text: alignment columns with 0-based ``pos`` and an order column; header lines are dropped."""
    f = F.split("value", "\t", -1)
    rows = lines(spark, paths).where(~F.col("value").rlike("^@[A-Z][A-Z]\t")).withColumn("_pos", F.monotonically_increasing_id()).withColumn("_f", f).where(F.size("_f") >= 11)

    def text(i: int) -> Column:
        return F.get("_f", F.lit(i))

    return rows.select(
        "_pos", text(0).alias("qname"), text(1).try_cast("int").alias("flag"), F.nullif(text(2), F.lit("*")).alias("rname"), (text(3).try_cast("bigint") - 1).alias("pos"),
        text(4).try_cast("int").alias("mapq"), text(5).alias("cigar"), text(9).alias("seq"), text(10).alias("qual"),
    )


# ---- tracks and tables ----
def bedgraph(spark: SparkSession, paths: Paths) -> DataFrame:
    """S25, text: (sample, chrom, start, end, value); sample is the file's name up to its first dot."""
    rows = lines(spark, paths).where(~F.col("value").rlike("^(track|browser|#)")).withColumn("_f", F.split("value", r"\s+"))
    return rows.select(sample_name(F.col("path")).alias("sample"), F.get("_f", F.lit(0)).alias("chrom"), *[F.get("_f", F.lit(i)).try_cast("bigint").alias(n) for i, n in ((1, "start"), (2, "end"))], F.get("_f", F.lit(3)).try_cast("double").alias("value"))


def sample_name(path: Column) -> Column:
    """base name up to the first dot."""
    return F.substring_index(F.substring_index(path, "/", -1), ".", 1)


def table(spark: SparkSession, path: str, header: bool = True, sep: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """A delimited table; commas for .csv, else tabs. Spreadsheets are not supported."""
    if path.endswith((".xlsx", ".xls")):
        raise ValueError("spreadsheets are not supported; save the sheet as .csv")
    reader = spark.read.option("header", header).option("sep", sep or ("," if path.endswith((".csv", ".csv.gz")) else "\t"))
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def chrom_sizes(spark: SparkSession, paths: Paths) -> DataFrame:
    """(chrom, length) of two columns between white space."""
    f = F.split(F.trim("value"), r"\s+")
    return lines(spark, paths).select(F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).try_cast("bigint").alias("length"))


def feature_counts(spark: SparkSession, path: str, columns: tuple[int, ...] = (0, 5, 6)) -> DataFrame:
    """Chosen columns by ordinal; exactly three mean Gene, Length and one sample. Sample names are base names up to the first dot."""
    df = spark.read.option("comment", "#").option("sep", "\t").option("header", True).option("inferSchema", True).csv(path)
    chosen = [df.columns[i] for i in columns]
    fixed = 2 if len(columns) == 3 else 1
    names = ["Gene", "Length"][:fixed] + [c.rsplit("/", 1)[-1].split(".")[0] for c in chosen[fixed:]]
    return df.select(*[F.col(f"`{c}`") for c in chosen]).toDF(*names)


def name_list(spark: SparkSession, paths: Paths) -> DataFrame:
    """(name) of every piece between white space."""
    return lines(spark, paths).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("name")).where("name <> ''")


def gene_model(spark: SparkSession, path: str) -> DataFrame:
    """A stored gene model (see ``sinks.gene_model``)."""
    return spark.read.parquet(path)
