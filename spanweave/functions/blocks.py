"""CIGAR, blocks, strands and feature geometry as column expressions (F7-F16, F19, W5). Blocks are ascending arrays of (start, end) structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: operation letters, by code.
CIGAR = "MIDNSHP=XBp"
BLOCKS = "array<struct<start:bigint,end:bigint>>"


def block(start: Column, end: Column) -> Column:
    return F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"))


def cigar_tuples(cigar: Column) -> Column:
    """(code, length) of each operation."""
    form = f"([-0-9]+)([{CIGAR}])"
    pairs = F.arrays_zip(F.regexp_extract_all(cigar, F.lit(form), 2).alias("c"), F.regexp_extract_all(cigar, F.lit(form), 1).alias("n"))
    return F.transform(pairs, lambda x: F.struct((F.call_function("instr", F.lit(CIGAR), x["c"]) - 1).alias("code"), x["n"].cast("bigint").alias("length")))


def cigar_blocks(start: Column, tuples: Column, shift: Column | int = 0, match_letters: bool = True) -> Column:
    """F8: reference blocks; M and D extend, N, P and p skip, ``=`` and ``X`` extend unless ``match_letters`` is off; touching blocks are one."""
    extend = [0, 2, 7, 8] if match_letters else [0, 2]
    first = F.struct((start + shift).cast("bigint").alias("at"), F.array().cast(BLOCKS).alias("blocks"))

    def step(acc: Column, t: Column) -> Column:
        at, blocks = acc["at"], acc["blocks"]
        last = F.try_element_at(blocks, F.lit(-1))
        end = at + t["length"]
        joined = F.concat(F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0))), F.array(block(last["start"], end)))
        more = F.when(F.coalesce(last["end"] == at, F.lit(False)), joined).otherwise(F.array_append(blocks, block(at, end)))
        return F.when(t["code"].isin(extend), F.struct(end.alias("at"), more.alias("blocks"))).when(t["code"].isin(3, 6, 10), F.struct(end.alias("at"), blocks.alias("blocks"))).otherwise(acc)

    return F.aggregate(tuples, first, step, lambda acc: acc["blocks"])


def blocks_length(blocks: Column) -> Column:
    """F9."""
    return F.aggregate(blocks, F.lit(0).cast("bigint"), lambda a, b: a + b["end"] - b["start"])


def union_blocks(blocks: Column) -> Column:
    """The few blocks of one fragment, in any order, as ascending disjoint ones, touching ones joined. Blocks of whole genes go through ``intervals.merge``."""

    def step(acc: Column, b: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(block(last["start"], F.greatest(last["end"], b["end"]))))
        return F.when(F.coalesce(b["start"] <= last["end"], F.lit(False)), joined).otherwise(F.array_append(acc, b))

    return F.aggregate(F.array_sort(F.filter(blocks, lambda b: b["start"] < b["end"])), F.array().cast(BLOCKS), step)


def runs_of_one(values: Column) -> Column:
    """an ascending array of whole numbers as runs of steps of one."""

    def step(acc: Column, v: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.array_append(last, v)))
        return F.when(F.coalesce(F.try_element_at(last, F.lit(-1)) + 1 == v, F.lit(False)), joined).otherwise(F.array_append(acc, F.array(v)))

    return F.aggregate(values, F.filter(F.array(values), lambda x: F.lit(False)), step)


def fragment_strand(strand: Column, rule: str, read2: Column) -> Column:
    """strand of the fragment. Rules ``1+-,1-+,2++,2--`` and ``+-,-+`` flip it, ``1++,1--,2+-,2-+`` and ``++,--`` do not; the second read flips it once more; a second read without strand is ``+``, a first one stays without."""
    flips = rule in ("1+-,1-+,2++,2--", "+-,-+")
    second = F.coalesce(read2, F.lit(False))
    known = strand.isin("+", "-")
    flipped = F.when(strand == "+", "-").when(strand == "-", "+")
    out = F.when(second != F.lit(flips), flipped).otherwise(strand)
    return F.when(known, out).when(second, "+")


def tss(start: Column, end: Column, strand: Column) -> Column:
    """transcription start; ``end`` itself on the minus strand."""
    return F.when(strand == "-", end).otherwise(start)


def tes(start: Column, end: Column, strand: Column) -> Column:
    return F.when(strand == "-", start).otherwise(end)


def tss_region(start: Column, end: Column, strand: Column, low: int, high: int) -> Column:
    """from ``low`` to ``high`` around the start, in the feature's direction."""
    return F.when(strand == "-", block(end - high, end - low)).otherwise(block(start + low, start + high))


def downstream(start: Column, end: Column, strand: Column, length: int) -> Column:
    return F.when(strand == "-", block(start - length, start)).otherwise(block(end, end + length))


def by_strand(before: Column, after: Column, strand: Column) -> tuple[Column, Column]:
    """distances upstream and downstream."""
    return F.when(strand == "-", after).otherwise(before), F.when(strand == "-", before).otherwise(after)


def clip(blocks: Column, lo: Column | None, hi: Column | None) -> Column:
    """Parts of blocks within [lo, hi)."""

    def one(b: Column) -> Column:
        s, e = b["start"], b["end"]
        return block(s if lo is None else F.greatest(s, lo), e if hi is None else F.least(e, hi))

    return F.filter(F.transform(blocks, one), lambda b: b["start"] < b["end"])


def cds_exons(exons: Column, cds_start: Column, cds_end: Column) -> Column:
    """F14; empty without a coding region."""
    return F.when(cds_start.isNull() | cds_end.isNull(), F.array().cast(BLOCKS)).otherwise(clip(exons, cds_start, cds_end))


def utr5(exons: Column, cds_start: Column, cds_end: Column, strand: Column) -> Column:
    left, right = clip(exons, None, cds_start), clip(exons, cds_end, None)
    return F.when(cds_start.isNull() | cds_end.isNull(), F.array().cast(BLOCKS)).when(strand == "-", right).otherwise(left)


def utr3(exons: Column, cds_start: Column, cds_end: Column, strand: Column) -> Column:
    left, right = clip(exons, None, cds_start), clip(exons, cds_end, None)
    return F.when(cds_start.isNull() | cds_end.isNull(), F.array().cast(BLOCKS)).when(strand == "-", left).otherwise(right)


def start_codon(cds_start: Column, cds_end: Column, strand: Column) -> Column:
    """F15; null without a coding region."""
    return F.when(cds_start.isNotNull() & cds_end.isNotNull(), F.when(strand == "-", block(cds_end - 3, cds_end)).otherwise(block(cds_start, cds_start + 3)))


def stop_codon(cds_start: Column, cds_end: Column, strand: Column) -> Column:
    return F.when(cds_start.isNotNull() & cds_end.isNotNull(), F.when(strand == "-", block(cds_start, cds_start + 3)).otherwise(block(cds_end - 3, cds_end)))


def introns(exons: Column) -> Column:
    """What lies between neighbouring blocks; none for one block or none, empty ones left out."""
    pairs = F.arrays_zip(F.slice(exons, 1, F.greatest(F.size(exons) - 1, F.lit(0))).alias("a"), F.slice(exons, 2, F.greatest(F.size(exons) - 1, F.lit(0))).alias("b"))
    return F.filter(F.transform(pairs, lambda p: block(p["a"]["end"], p["b"]["start"])), lambda x: x["start"] < x["end"])


def protein_coding(kind: Column) -> Column:
    """F19, for loci too, where types are a comma list: all must agree."""
    return F.coalesce(F.forall(F.split(kind, ","), lambda x: x == "protein_coding"), F.lit(False))


def bed12_blocks(start: Column, sizes: Column, starts: Column) -> Column:
    """Absolute blocks, ascending, of comma lists; pieces that are no whole numbers give null bounds (problem 2 takes such fields apart)."""
    numbers = [F.transform(F.filter(F.split(c, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).try_cast("bigint")) for c in (starts, sizes)]
    return F.array_sort(F.transform(F.arrays_zip(numbers[0].alias("s"), numbers[1].alias("n")), lambda x: block(start + x["s"], start + x["s"] + x["n"])))
