"""Sequence functions as column expressions (F1-F6, F20, F21, F3, A14). A null stays null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Complements of the IUPAC letters, upper case; other letters have none.
LETTERS = "ACGTNWSKMYRHBVD&"
COMPLEMENTS = "TGCANWSMKRYDVBH&"
#: Fixed value: letters of the notation.
NOTATION = "ACGTUWSMKRYBDHVNZ"
#: The bases that each ambiguous letter stands for.
AMBIGUOUS = {
    "W": "ATU", "S": "CG", "M": "AC", "K": "GTU", "R": "AG", "Y": "CTU", "B": "CGTU", "D": "AGTU", "H": "ACTU", "V": "ACG", "N": "ACGTU",
    "T": "TU", "U": "TU",
}
_UPPER = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def upper(s: Column) -> Column:
    """ASCII letters only, so that no letter becomes two."""
    return F.translate(s, *_UPPER)


def reverse_complement(s: Column, strict: bool = True) -> Column:
    """F1; a letter without a complement raises, or with ``strict`` off stays as it is."""
    out = F.reverse(F.translate(upper(s), LETTERS, COMPLEMENTS))
    if not strict:
        return out
    return F.when(upper(s).rlike(f"[^{LETTERS}]"), F.raise_error(F.concat(F.lit("no complement in: "), s))).otherwise(out)


def to_dna(s: Column) -> Column:
    """upper case, letters of the notation only, U as T."""
    return F.translate(F.regexp_replace(upper(s), f"[^{NOTATION}]", ""), "U", "T")


def to_rna(s: Column) -> Column:
    return F.translate(F.regexp_replace(upper(s), f"[^{NOTATION}]", ""), "T", "U")


def u_to_t(s: Column) -> Column:
    """F6, either case."""
    return F.translate(s, "Uu", "Tt")


def pattern(motif: str) -> str:
    """a motif in IUPAC letters as a regular expression."""
    return "".join(f"[{AMBIGUOUS[c]}]" if c in AMBIGUOUS else c for c in motif.upper())


def motif_first(s: Column, motif: str) -> Column:
    """F5 search: the first match, or null."""
    return F.nullif(F.regexp_extract(s, f"({pattern(motif)})", 1), F.lit(""))


def motif_at_start(s: Column, motif: str) -> Column:
    """F5 match: does the sequence begin with the motif."""
    return s.rlike("^" + pattern(motif))


def motif_all(s: Column, motif: str) -> Column:
    """F5 findall: matches that do not overlap, from the left."""
    return F.regexp_extract_all(s, F.lit(f"({pattern(motif)})"), 1)


def motif_positions(s: Column, motif: str) -> Column:
    """F5 finditer: (start, end) of each match, from 0. All matches have the motif's length, so the pieces between them give the places."""
    n = len(motif)
    gaps = F.transform(F.split(s, pattern(motif), -1), lambda x: F.length(x))
    places = F.aggregate(
        F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))),
        F.array().cast("array<int>"),
        lambda acc, g: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)) + n, F.lit(0)) + g),
    )
    return F.transform(places, lambda p: F.struct(p.alias("start"), (p + n).alias("end")))


def wrap(s: Column, width: int = 60) -> Column:
    """lines of ``width`` characters."""
    return F.regexp_replace(s, f"(.{{{width}}})(?=.)", "$1\n")


def location(s: Column) -> Column:
    """``chrom:start-end(strand)`` as struct, the strand optional; anything else raises."""
    form = r"^([^:\s]+):(\d+)-(\d+)(?:\(([+-])\))?$"
    parts = [F.regexp_extract(s, form, i) for i in range(1, 5)]
    got = F.struct(parts[0].alias("chrom"), parts[1].cast("bigint").alias("start"), parts[2].cast("bigint").alias("end"), F.nullif(parts[3], F.lit("")).alias("strand"))
    return F.when(s.rlike(form), got).when(s.isNotNull(), F.raise_error(F.concat(F.lit("no location: "), s)))


def fetch(seq: Column, start: Column, end: Column, strand: Column | None = None) -> Column:
    """[start, end) of a sequence, clamped to it, reverse complement on ``-``."""
    lo, hi = F.greatest(start, F.lit(0)), F.least(end, F.length(seq).cast("bigint"))
    got = F.when(hi > lo, F.substring(seq, (lo + 1).cast("int"), (hi - lo).cast("int"))).otherwise("")
    return got if strand is None else F.when(strand == "-", reverse_complement(got, False)).otherwise(got)


def fetch_blocks(seq: Column, blocks: Column, strand: Column | None = None) -> Column:
    """The blocks' sequences in a row, reverse complement once at the end."""
    got = F.array_join(F.transform(blocks, lambda b: fetch(seq, b["start"], b["end"])), "")
    return got if strand is None else F.when(strand == "-", reverse_complement(got, False)).otherwise(got)


def usual_chrom(name: Column) -> Column:
    """S22."""
    return name.rlike(r"^(chr|\d.*|X|Y|M|MT)")


def with_length(df: DataFrame, sequence: str) -> DataFrame:
    """A14."""
    return df.withColumn("length", F.length(sequence))
