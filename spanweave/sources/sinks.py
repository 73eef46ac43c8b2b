"""Sinks (K1-K15): text lines of each format and writers. Row order within a file follows the frame's sort."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanweave.functions.sequence import wrap


#: Fixed value: signs that a field cannot hold, as GFF3 writes them; the percent sign is escaped first and restored last.
ESCAPES = (("%", "%25"), ("\t", "%09"), ("\r", "%0D"), ("\n", "%0A"))
#: A text that reads like a null, escaped.
NONE_TEXT = "%4Eone"


def escaped(field: Column) -> Column:
    """A text as a field without tabs and line ends; ``text.unescaped`` gives it back."""
    for sign, code in ESCAPES:
        field = F.replace(field, F.lit(sign), F.lit(code))
    return F.when(field == "None", NONE_TEXT).otherwise(field)


def row_text(df: DataFrame, columns: list[str] | None = None, escape: bool = False) -> DataFrame:
    """(value): columns between tabs, nulls as ``None``. With ``escape`` every text can be read back, whatever it holds."""
    texts = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)} if escape else set()
    fields = [escaped(F.col(c)) if c in texts else F.col(c).cast("string") for c in columns or df.columns]
    return df.select(F.concat_ws("\t", *[F.coalesce(x, F.lit("None")) for x in fields]).alias("value"))


def write_lines(df: DataFrame, path: str, column: str = "value", gzip: bool = False) -> None:
    """K2, K4."""
    w = df.select(column).write.mode("overwrite")
    (w.option("compression", "gzip") if gzip else w).text(path)


def tee(df: DataFrame, path: str, column: str = "value") -> DataFrame:
    """K3: written, and read back for what follows."""
    write_lines(df, path, column)
    return df.sparkSession.read.text(path).withColumnRenamed("value", column)


def show_lines(df: DataFrame) -> Iterator[Row]:
    """K1: rows one by one at the driver, a partition at a time."""
    return df.toLocalIterator()


def write_table(df: DataFrame, path: str, header: bool = True, sep: str | None = None) -> None:
    """K5."""
    if path.endswith((".xlsx", ".xls")):
        raise ValueError("spreadsheets are not supported")
    df.write.mode("overwrite").option("header", header).option("sep", sep or ("," if path.endswith(".csv") else "\t")).csv(path)


def fastq_text(df: DataFrame, comments: bool = True) -> DataFrame:
    """(value) of four lines; a missing quality is ``F`` throughout."""
    name = F.concat(F.lit("@"), F.concat_ws(" ", "name", *(["comment"] if comments and "comment" in df.columns else [])))
    quality = F.col("quality") if "quality" in df.columns else F.lit(None).cast("string")
    return df.select(F.concat_ws("\n", name, "sequence", F.lit("+"), F.coalesce(quality, F.repeat(F.lit("F"), F.length("sequence")))).alias("value"))


def fasta_text(df: DataFrame, wrap_at: int | None = None) -> DataFrame:
    """(value) of a header and the sequence, in lines of ``wrap_at`` letters or one."""
    seq = wrap(F.col("sequence"), wrap_at) if wrap_at else F.col("sequence")
    return df.select(F.concat(F.lit(">"), "name", F.lit("\n"), seq).alias("value"))


def choose_records(df: DataFrame, refs: list[str], name: str = "name") -> DataFrame:
    """One name is a pattern; several are exact, in their order (column ``_order``)."""
    if len(refs) == 1:
        return df.where(F.col(name).rlike(refs[0])).withColumn("_order", F.lit(0))
    wanted = F.create_map(*[F.lit(y) for i, r in enumerate(refs) for y in (r, i)])
    return df.withColumn("_order", wanted[F.col(name)]).where("_order IS NOT NULL").orderBy("_order")


def sam_text(df: DataFrame) -> DataFrame:
    """(value) of alignment lines."""
    star = F.lit("*")
    return df.select(
        F.concat_ws("\t", "qname", F.col("flag").cast("string"), F.coalesce("rname", star), (F.col("pos") + 1).cast("string"), F.col("mapq").cast("string"), F.coalesce("cigar", star), star, F.lit("0"), F.lit("0"), F.coalesce("seq", star), F.coalesce("qual", star)).alias("value")
    )


def loci_bed(df: DataFrame) -> DataFrame:
    """BED6 of loci (name = gene_name, score = count), sorted by place."""
    return df.orderBy("chrom", "start").select("chrom", "start", "end", F.col("gene_name").alias("name"), F.col("count").cast("string").alias("score"), "strand")


def profile_matrix(df: DataFrame, path: str) -> None:
    """A profile as (sample, bin, value)."""
    df.select("sample", "bin", "value").write.mode("overwrite").parquet(path)


def gene_model(df: DataFrame, path: str) -> None:
    """Loci by strand."""
    df.write.mode("overwrite").partitionBy("strand").parquet(path)


def collected(df: DataFrame, value: str, kind: str = "list", key: str | None = None) -> Column:
    """Rows as one list, set or map column value, for groups of bounded size."""
    if kind == "dict":
        return F.map_from_entries(F.collect_list(F.struct(key, value)))
    return (F.collect_set if kind == "set" else F.collect_list)(value)
