"""Summaries of tool logs (S32, F22-F24): a frame (path, content), read with ``wholetext``, to one row per file of string columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.sources.text import sample_name


def read(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r", "").alias("content"))


def _head(n: int) -> Column:
    return F.array_join(F.slice(_lines(), 1, n), "\n")


def _lines() -> Column:
    """Trimmed lines that are not empty."""
    return F.filter(F.transform(F.split("content", "\n"), lambda x: F.trim(x)), lambda x: x != "")


def _get(text: Column, form: str) -> Column:
    return F.nullif(F.regexp_extract(text, form, 1), F.lit(""))


def _word(i: int) -> Column:
    """First word of the i-th line."""
    return F.substring_index(F.get(_lines(), F.lit(i)), " ", 1)


def _total(*lines: int) -> Column:
    return reduce(lambda a, b: a + b, [_word(i).try_cast("bigint") for i in lines]).cast("string")


def cutadapt(df: DataFrame) -> DataFrame:
    text = F.replace(_head(15), F.lit(","), F.lit(""))
    out = {"total_read_pairs": _get(text, r"Total read pairs processed:\s*(\d+)")}
    for i in (1, 2):
        out[f"read{i}_with_adapter"] = _get(text, rf"Read {i} with adapter:\s*(\d+)")
        out[f"read{i}_with_adapter_percent"] = _get(text, rf"Read {i} with adapter:\s*\d+ \(([^)]*)\)")
    return _rows(df, out)


def fastp(df: DataFrame) -> DataFrame:
    counts = F.regexp_extract_all(_head(22), F.lit(r"total reads:\s*(\S+)"), 1)
    return _rows(df, {"total_read_pairs": F.get(counts, F.lit(0)), "qc_read_pairs": F.get(counts, F.lit(2))})


def bowtie2(df: DataFrame) -> DataFrame:
    return _rows(df, {"input_read_pairs": _word(0), "mapped_read_pairs": _total(3, 4), "alignment_rate": _word(5)})


def hisat2(df: DataFrame) -> DataFrame:
    last = F.substring_index(F.element_at(_lines(), -1), " ", 1)
    return _rows(df, {"input_read_pairs": _word(0), "mapped_read_pairs": _total(3, 4, 7, 12, 13), "alignment_rate": last})


def star(df: DataFrame) -> DataFrame:
    c = F.col("content")

    def value(label: str) -> Column:
        return _get(c, rf"(?m)^\s*{label}[^\n]*?(\S+)[ \t]*$")

    uniq, multi = value("Uniquely mapped reads number"), value("Number of reads mapped to multiple loci")
    ur, mr = value("Uniquely mapped reads %"), value("% of reads mapped to multiple loci")
    rate = F.format_string("%.2f%%", F.replace(ur, F.lit("%"), F.lit("")).try_cast("double") + F.replace(mr, F.lit("%"), F.lit("")).try_cast("double"))
    return _rows(df, {
        "input_read_pairs": value("Number of input reads"), "unique_mapped": uniq, "unique_rate": ur, "multiple_mapped": multi, "multiple_rate": mr,
        "mapped_read_pairs": (uniq.try_cast("bigint") + multi.try_cast("bigint")).cast("string"), "alignment_rate": rate,
    })


def picard_duplicates(df: DataFrame) -> DataFrame:
    line = F.get(F.filter(F.slice(_lines(), 1, 10), lambda x: x.startswith("Unknown Library")), F.lit(0))
    words = F.split(line, r"\s+")
    return _rows(df, {"duplication_rate": F.format_string("%.2f%%", F.element_at(words, -2).try_cast("double") * 100), "estimated_librarysize": F.element_at(words, -1)})


def flagstat(df: DataFrame) -> DataFrame:
    n = _get(F.col("content"), r"(?m)^(\d+)[^\n]*properly paired")
    return _rows(df, {"filtered_read_pairs": F.floor(n.try_cast("bigint") / 2)}).withColumn("filtered_read_pairs", F.col("filtered_read_pairs").cast("string"))


def _rows(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.select(sample_name(F.col("path")).alias("samples"), *[c.alias(n) for n, c in columns.items()])


def sample_parts(df: DataFrame, column: str = "samples") -> DataFrame:
    """``replicates`` repN by the last digit (rep0 without one), ``group`` the name without it."""
    digit = F.regexp_extract(column, r"(\d)$", 1)
    return df.withColumn("replicates", F.concat(F.lit("rep"), F.when(digit == "", "0").otherwise(digit))).withColumn("group", F.regexp_replace(F.regexp_replace(column, r"(?:rep)?\d$", ""), r"[_-]+$", ""))


def summary(parts: list[DataFrame]) -> DataFrame:
    """The tools' rows side by side by sample."""
    out = parts[0]
    for i, p in enumerate(parts[1:], 1):
        out = out.join(p.withColumnsRenamed({c: f"{c}_{i}" for c in p.columns if c != "samples" and c in out.columns}), "samples", "full")
    return sample_parts(out)
