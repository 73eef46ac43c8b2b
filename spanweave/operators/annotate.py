"""Annotation of intervals and reads with gene features (F17, F18, J9, C11 and the flagship rules).

A binned left overlap join finds the features whose promoter-to-downstream hull a read touches; labels are an array of conditions; hits fall into tiers, of which the best
one of each read is kept; the answer is the first label in the order of priority. Reads without a hit are Intergenic.

Defined results: reads need a unique ``id``; reads with a null position are Intergenic; several features give sorted lists; ties are all kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.functions import blocks as bl
from spanweave.operators.intervals import any_overlap, overlap_join, overlaps
from spanweave.operators.reads import READ2, has, mapped, mate_pairs, with_blocks
from spanweave.runtime import once

#: Labels, the most telling first, and the order used for peaks.
PRIORITY = ("TSS", "TES", "StartCondon", "StopCondon", "5UTR", "3UTR", "CDS", "Exon", "Intron", "Upstream", "Downstream", "Intergenic")
PEAK_PRIORITY = ("Upstream", "5UTR", "3UTR", "Exon", "CDS", "Intron", "Downstream", "Intergenic")
_POINTS = ("TSS", "TES", "StartCondon", "StopCondon", "5UTR", "3UTR", "CDS", "Exon")
_FLANKS = ("Upstream", "Downstream", "Intergenic")


def primary(labels: Column, priority: tuple[str, ...] = PRIORITY) -> Column:
    """F18."""
    return F.get(F.array_intersect(F.array(*map(F.lit, priority)), labels), F.lit(0))


def _hull(region: tuple[int, int], down: int) -> tuple[Column, Column, Column, Column]:
    s, e, strand = F.col("start"), F.col("end"), F.col("strand")
    up, dn = bl.tss_region(s, e, strand, *region), bl.downstream(s, e, strand, down)
    return up, dn, F.least(up["start"], dn["start"]), F.greatest(up["end"], dn["end"])


def _conditions(blocks: Column, f: dict[str, Column], pos: Column, region: tuple[int, int], down: int, tss: bool = False, tes: bool = False, start_codon: bool = False, stop_codon: bool = False) -> Column:
    """Labels by overlap, before introns."""
    s, e, strand, ex, cs, ce = (f[k] for k in ("start", "end", "strand", "exons", "cds_start", "cds_end"))
    up, dn = bl.tss_region(s, e, strand, *region), bl.downstream(s, e, strand, down)
    first, last = F.get(blocks, F.lit(0))["start"], F.element_at(blocks, -1)["end"]

    def hits(x: Column) -> Column:
        return any_overlap(blocks, x)

    def point(x: Column) -> Column:
        return hits(F.array(bl.block(x, x + 1)))

    coding = bl.protein_coding(f["type"])
    cds = (ex, cs, ce)
    none = F.lit(False)
    conds = {
        "Intergenic": (last < pos[0]) | (first > pos[3]),
        "TSS": point(bl.tss(s, e, strand)) if tss else none,
        "TES": point(bl.tes(s, e, strand)) if tes else none,
        "Upstream": hits(F.array(up)),
        "5UTR": coding & hits(bl.utr5(*cds, strand)),
        "3UTR": coding & hits(bl.utr3(*cds, strand)),
        "CDS": coding & hits(bl.cds_exons(*cds)),
        "StartCondon": coding & F.coalesce(hits(F.array(bl.start_codon(cs, ce, strand))), none) if start_codon else none,
        "StopCondon": coding & F.coalesce(hits(F.array(bl.stop_codon(cs, ce, strand))), none) if stop_codon else none,
        "Exon": ~coding & hits(ex),
        "Downstream": hits(F.array(dn)),
    }
    return F.filter(F.array(*[F.when(c, k) for k, c in conds.items()]), lambda x: x.isNotNull())


def _positions(f: dict[str, Column], region: tuple[int, int], down: int) -> Column:
    a = (f["start"], f["end"], f["strand"])
    up, dn = bl.tss_region(*a, *region), bl.downstream(*a, down)
    return F.array_sort(F.array(up["start"], up["end"], dn["start"], dn["end"]))


def _finished(got: Column, blocks: Column, pos: Column) -> Column:
    body = F.exists(blocks, lambda b: overlaps(b["start"], b["end"], pos[1], pos[2]))
    exonic = F.arrays_overlap(got, F.array(*map(F.lit, ("5UTR", "3UTR", "CDS", "Exon"))))
    return F.when(F.size(got) == 0, F.array(F.lit("Intron"))).when(~exonic & body, F.array_append(got, F.lit("Intron"))).otherwise(got)


def with_labels(df: DataFrame, f: dict[str, Column], region: tuple[int, int] = (-3000, 0), down: int = 3000, name: str = "labels", **flags: bool) -> DataFrame:
    """``labels`` of each row's read (``blocks``) and feature (columns type, start, end, strand, cds_start, cds_end, exons). Steps are columns of their own, so that none is computed twice."""
    df = df.withColumn("_pos", _positions(f, region, down))
    df = df.withColumn("_got", _conditions(F.col("blocks"), f, F.col("_pos"), region, down, **flags))
    return df.withColumn(name, _finished(F.col("_got"), F.col("blocks"), F.col("_pos"))).drop("_pos", "_got")


def tier(x: Column, priority: tuple[str, ...] = PRIORITY) -> Column:
    """1 within a feature and not Intron, 2 flank with exon or point label, 3 Intron alone, 4 flank with Intron, 5 others."""
    flank = F.arrays_overlap(x, F.array(*map(F.lit, _FLANKS)))
    telling = F.arrays_overlap(x, F.array(*map(F.lit, _POINTS)))
    return F.when(~flank & (primary(x, priority) != "Intron"), 1).when(flank & telling, 2).when(~flank, 3).when(F.array_contains(x, "Intron"), 4).otherwise(5)


def annotate_hits(reads: DataFrame, features: DataFrame, stranded: bool = False, region: tuple[int, int] = (-3000, 0), down: int = 3000, **flags: bool) -> DataFrame:
    """Every read with every feature whose hull it touches: id, feature id, name, type, place, ``labels`` and ``tier``; reads without a hit once, labels null.

    reads: id, chrom, start, end, strand, blocks (or none: the interval itself); features: id, name, type, chrom, start, end, strand, cds_start, cds_end, exons and, if given, gene_type.
    """
    if "blocks" not in reads.columns:
        reads = reads.withColumn("blocks", F.array(bl.block(F.col("start"), F.col("end"))))
    _, _, lo, hi = _hull(region, down)
    feats = features.select("*", F.struct("start", "end").alias("place")).withColumns({"_lo": lo, "_hi": hi}).drop("start", "end").withColumnsRenamed({"_lo": "start", "_hi": "end"})
    keys = ["chrom", "strand"] if stranded else ["chrom"]
    hits = overlap_join(reads.select("id", "chrom", "start", "end", "strand", "blocks"), feats, keys, "left", ident="id")
    f = {k: F.col(k + "_b") for k in ("type", "strand", "cds_start", "cds_end", "exons")} | {"start": F.col("place_b.start"), "end": F.col("place_b.end")}
    found = F.col("id_b").isNotNull()
    out = with_labels(hits, f, region, down, **flags).withColumn("labels", F.when(found, F.col("labels")))
    return out.withColumn("tier", F.when(found, tier(F.col("labels")))).select("id", "chrom", "start", "end", "strand", F.col("id_b").alias("feature_id"), F.col("name_b").alias("name"), F.col("type_b").alias("type"), (F.col("gene_type_b") if "gene_type_b" in hits.columns else F.col("type_b")).alias("gene_type"), F.col("strand_b").alias("feature_strand"), F.col("place_b.start").alias("feature_start"), F.col("place_b.end").alias("feature_end"), "labels", "tier")


def annotate(reads: DataFrame, features: DataFrame, stranded: bool = False, region: tuple[int, int] = (-3000, 0), down: int = 3000, upstream_name: str = "Upstream", downstream_name: str = "Downstream", priority: tuple[str, ...] = PRIORITY, **flags: bool) -> DataFrame:
    """One row per read: annotation, starts, ends, strands, names, ids and types of the features of its best tier; ``*`` without a hit.

    The types are the gene types of these features, unless that brought in protein_coding where none of their own types is.
    """
    hits = annotate_hits(reads, features, stranded, region, down, **flags)
    best = hits.withColumn("_best", F.min("tier").over(Window.partitionBy("id"))).where(F.col("tier").eqNullSafe(F.col("_best")))  # hits of one read

    def listed(c: str, name: str) -> Column:
        return F.coalesce(F.nullif(F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ","), F.lit("")), F.lit("*")).alias(name)

    coding = F.lit("protein_coding")
    brought = F.array_contains(F.collect_set("gene_type"), coding) & ~F.array_contains(F.collect_set("type"), coding)
    out = best.groupBy("id", "chrom", "start", "end", "strand").agg(
        primary(F.collect_set(primary(F.col("labels"), priority)), priority).alias("anno"),
        listed("feature_start", "starts"), listed("feature_end", "ends"), listed("feature_strand", "strands"), listed("name", "names"), listed("feature_id", "ids"),
        F.when(brought, listed("type", "types")).otherwise(listed("gene_type", "types")).alias("types"),
    )
    name = F.coalesce("anno", F.lit("Intergenic"))
    return out.withColumn("anno", F.when(name == "Upstream", upstream_name).when(name == "Downstream", downstream_name).otherwise(name))


def fragments(alignments: DataFrame, rule: str = "1+-,1-+,2++,2--", paired: bool = False, order: str = "_pos") -> DataFrame:
    """What of an alignment file is annotated: id, qname, chrom, start, end, blocks and the strand that the library's ``rule`` gives.

    Every mapped read by itself, or with ``paired`` the mates of a name together: mates of one chromosome and strand whose blocks overlap are one fragment with the union
    of their blocks, others stay alone. ``id`` is the order value of the read, of a fragment that of its first mate; names without a usable mate give nothing.
    """
    reads = with_blocks(mapped(alignments)).where(F.size("blocks") > 0)
    second = has(READ2)
    if not paired:
        rows = reads.select(F.col(order).alias("id"), "qname", F.col("rname").alias("chrom"), "strand", second.alias("_second"), "blocks")
    else:
        pairs = mate_pairs(reads, "qname", F.when(second, 2).otherwise(1), order, [order, "rname", "strand", "blocks"])
        one, two = F.col("r1"), F.col("r2")
        joined = F.coalesce((one["rname"] == two["rname"]) & (one["strand"] == two["strand"]) & any_overlap(one["blocks"], two["blocks"]), F.lit(False))

        def alone(r: Column, is_second: bool) -> Column:
            return F.when(r.isNotNull(), F.struct(r[order].alias("id"), r["rname"].alias("chrom"), r["strand"].alias("strand"), F.lit(is_second).alias("_second"), r["blocks"].alias("blocks")))

        whole = F.struct(one[order].alias("id"), one["rname"].alias("chrom"), one["strand"].alias("strand"), F.lit(False).alias("_second"), bl.union_blocks(F.concat(one["blocks"], two["blocks"])).alias("blocks"))
        each = F.when(joined, F.array(whole)).otherwise(F.filter(F.array(alone(one, False), alone(two, True)), lambda x: x.isNotNull()))
        rows = pairs.select("qname", F.explode(each).alias("_x")).select("qname", "_x.*")
    ends = {"start": F.get("blocks", F.lit(0))["start"], "end": F.element_at("blocks", -1)["end"]}
    return rows.withColumns({**ends, "strand": bl.fragment_strand(F.col("strand"), rule, F.col("_second"))}).select("id", "qname", "chrom", "start", "end", "strand", "blocks")


def annotate_alignments(alignments: DataFrame, features: DataFrame, rule: str = "1+-,1-+,2++,2--", paired: bool = False, order: str = "_pos", **how) -> DataFrame:
    """``annotate`` for an alignment file, read by read or fragment by fragment (see ``fragments``), with ``qname``."""
    reads = once(fragments(alignments, rule, paired, order))
    return annotate(reads.drop("qname"), features, **how).join(reads.select("id", "qname"), "id")
