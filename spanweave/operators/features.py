"""Transcripts, genes and loci (A16-A21, W2-W5, I9, C1, C6, C8). Feature rows are GTF rows with ids as columns; coordinates of the results are 0-based and half-open.

Expected columns: order (unique), chrom, feature, start, end (1-based, closed), strand, gene_id, transcript_id, gene_name, transcript_name, gene_type, transcript_type.
Defined results: rows without a transcript id build no transcript; repeated rows count once; the first value by order wins; without exons there is no transcript.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.functions import blocks as bl
from spanweave.operators.intervals import merge, overlap_join, sweep
from spanweave.runtime import cut

_NAMES = ["gene_id", "gene_name", "transcript_name", "gene_type", "transcript_type"]


def _coding() -> Column:
    return F.col("feature").isin("CDS", "stop_codon")


def _exon() -> Column:
    return F.col("feature") == "exon"


def transcripts(gtf: DataFrame, order: str = "record_id") -> DataFrame:
    """Transcript rows with ``exons``, nullable CDS bounds, and types falling back from transcript to gene."""
    rows = gtf.where(F.col("transcript_id").isNotNull() & (_exon() | _coding()))
    first = [F.min_by(c, F.when(_exon() & F.col(c).isNotNull(), F.col(order))).alias(c) for c in [*_NAMES, "chrom", "strand"]]
    exon = F.when(_exon(), bl.block(F.col("start") - 1, F.col("end")))
    out = rows.groupBy("transcript_id").agg(
        *first,
        F.min(F.when(_exon(), F.col("start") - 1)).alias("start"),
        F.max(F.when(_exon(), F.col("end"))).alias("end"),
        F.min(F.when(_coding(), F.col("start") - 1)).alias("cds_start"),
        F.max(F.when(_coding(), F.col("end"))).alias("cds_end"),
        F.array_sort(F.collect_set(exon)).alias("exons"),
    )
    out = out.where(F.size("exons") > 0)
    genes = gtf.where((F.col("feature") == "gene") & F.col("gene_id").isNotNull()).groupBy("gene_id").agg(F.min_by("gene_type", order).alias("_gene_type"))
    out = out.join(genes, "gene_id", "left").withColumn("gene_type", F.coalesce("gene_type", "_gene_type")).drop("_gene_type")
    return out.withColumn("transcript_type", F.coalesce("transcript_type", "gene_type")).withColumn("gene_name", F.coalesce("gene_name", "gene_id")).withColumn("transcript_name", F.coalesce("transcript_name", "gene_name"))


def _union(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ``exons``: the union of the exons of each key as ascending disjoint blocks, touching ones joined. The sweep merges them, whatever share of all rows one key has; only what
    is left of a key meets in one row."""
    each = rows.select(*keys, F.explode("exons").alias("_x")).select(*keys, "_x.start", "_x.end")
    return merge(each, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(bl.block(F.col("start"), F.col("end")))).alias("exons"))


def genes(tx: DataFrame) -> DataFrame:
    """Per gene the hull, the CDS hull and the union of exons."""
    tx = cut(tx.where("gene_id IS NOT NULL"))
    hulls = tx.groupBy("gene_id").agg(
        F.min_by("gene_name", "transcript_id").alias("gene_name"), F.min_by("gene_type", "transcript_id").alias("gene_type"), F.min_by("chrom", "transcript_id").alias("chrom"), F.min_by("strand", "transcript_id").alias("strand"),
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("cds_start").alias("cds_start"), F.max("cds_end").alias("cds_end"), F.count("*").alias("n"),
    )
    return hulls.join(_union(tx, ["gene_id"]), "gene_id")


def loci(tx: DataFrame, stranded: bool = True, drop_types: list[str] | None = None, drop_names: list[str] | None = None) -> DataFrame:
    """Transcripts that overlap or touch as one locus, names and types as sorted comma lists."""
    for name in drop_names or []:
        tx = tx.where(~F.coalesce(F.col("gene_name").startswith(name), F.lit(False)))
    if drop_types:
        tx = tx.where(~F.coalesce(F.col("gene_type").isin(drop_types), F.lit(False)))
    keys = ["chrom", "strand"] if stranded else ["chrom"]
    tx = cut(tx)  # read by the sweep and by the join
    runs = merge(tx, keys).select(*keys, "start", "end")
    hits = cut(overlap_join(tx, runs, keys).withColumnsRenamed({"start_b": "_s", "end_b": "_e"}))

    def listed(c: str) -> Column:
        return F.array_join(F.array_sort(F.collect_set(c)), ",").alias(c)

    def sorted_list(c: str, name: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct("start", "transcript_id", F.col(c).alias("v")))), lambda x: x["v"]).alias(name)

    out = hits.groupBy(*keys, "_s", "_e").agg(
        *[listed(c) for c in ("transcript_id", "gene_id", "gene_name", "gene_type", "transcript_type")],
        sorted_list("start", "starts"), sorted_list("end", "ends"),
        F.filter(sorted_list("cds_start", "x"), lambda x: x.isNotNull()).alias("cds_starts"), F.filter(sorted_list("cds_end", "x"), lambda x: x.isNotNull()).alias("cds_ends"),
        F.min("cds_start").alias("cds_start"), F.max("cds_end").alias("cds_end"), F.count("*").alias("count"),
    )
    return out.join(_union(hits, [*keys, "_s"]), [*keys, "_s"]).withColumnsRenamed({"_s": "start", "_e": "end"})


def with_distances(loc: DataFrame, keys: list[str], sizes: DataFrame | None = None) -> DataFrame:
    """``before`` and ``after`` of disjoint loci; at the chromosome's ends the start and what is left of its length (0 where that is unknown).

    The gaps of a sweep carry the distances, so that a chromosome with most loci is no single task.
    """
    gaps = sweep([loc], keys).where("n0 = 0").select(*keys, F.col("start").alias("_s"), F.col("end").alias("_e"))
    left = gaps.select(*keys, F.col("_e").alias("start"), (F.col("_e") - F.col("_s")).alias("before"))
    right = gaps.select(*keys, F.col("_s").alias("end"), (F.col("_e") - F.col("_s")).alias("after"))
    out = loc.join(left, [*keys, "start"], "left").join(right, [*keys, "end"], "left")
    out = out.withColumn("before", F.coalesce("before", "start"))
    if sizes is None:
        return out.withColumn("after", F.coalesce("after", F.lit(0)))
    return out.join(sizes.select("chrom", F.col("length").alias("_length")), "chrom", "left").withColumn("after", F.coalesce("after", F.col("_length") - F.col("end"), F.lit(0))).drop("_length")


def intron_rows(gtf: DataFrame, order: str = "record_id") -> DataFrame:
    """transcript_id, chrom, start, end, strand of what lies between neighbouring exons of a transcript."""
    exons = gtf.where(_exon() & F.col("transcript_id").isNotNull()).select("transcript_id", "chrom", "strand", (F.col("start") - 1).alias("s"), F.col("end").alias("e")).distinct()
    after = F.lead("s").over(Window.partitionBy("transcript_id").orderBy("s", "e"))  # exons of one transcript
    return exons.withColumn("end", after).where(F.col("end") > F.col("e")).select("transcript_id", "chrom", F.col("e").alias("start"), "end", "strand")


def bed6_rows(gtf: DataFrame, name: str = "transcript_id") -> DataFrame:
    """C1 bed6: (chrom, start, end, name, score, strand)."""
    return gtf.select("chrom", (F.col("start") - 1).alias("start"), "end", F.col(name).alias("name"), F.lit("0").alias("score"), "strand")


def bed12_rows(tx: DataFrame, name: str = "transcript_id") -> DataFrame:
    """A19, C1 bed12: block lists with a comma at the end; without CDS the thick part is empty at the end."""
    coding = F.col("cds_start").isNotNull()

    def text(f) -> Column:
        return F.concat(F.array_join(F.transform("exons", lambda b: f(b).cast("string")), ","), F.lit(","))

    return tx.select(
        "chrom", "start", "end", F.col(name).alias("name"), F.lit("0").alias("score"), "strand",
        F.when(coding, F.col("cds_start")).otherwise(F.col("end")).alias("thickStart"), F.when(coding, F.col("cds_end")).otherwise(F.col("end")).alias("thickEnd"),
        F.lit(0).alias("itemRgb"), F.size("exons").alias("blockCount"),
        text(lambda b: b["end"] - b["start"]).alias("blockSizes"), text(lambda b: b["start"] - F.col("start")).alias("blockStarts"),
    )


def gene_info(gtf: DataFrame) -> DataFrame:
    """C1 gene_info."""
    return gtf.where("feature = 'gene'").select("gene_id", F.coalesce("gene_name", "gene_id").alias("gene_name"), "gene_type", "strand")


def trans_info(gtf: DataFrame, order: str = "record_id") -> DataFrame:
    """A21, C1 trans_info: transcript rows, the gene's type where the row has none."""
    types = gtf.where("feature = 'gene' AND gene_id IS NOT NULL").groupBy("gene_id").agg(F.min_by("gene_type", order).alias("_type"))
    rows = gtf.where("feature = 'transcript'").join(types, "gene_id", "left")
    name = F.coalesce("gene_name", "gene_id")
    return rows.select(
        F.coalesce("transcript_id", "gene_id").alias("transcript_id"), F.coalesce("transcript_name", name).alias("transcript_name"), "transcript_type",
        "gene_id", name.alias("gene_name"), F.coalesce("gene_type", "_type").alias("gene_type"), "strand",
    )


def region_blocks(tx: DataFrame, kind: str) -> DataFrame:
    """``blocks`` of a region kind: all, exons, introns, first_exon, last_exon, first_intron, last_intron, 5utr, 3utr, cds; transcripts without any are left out."""
    ex, strand = F.col("exons"), F.col("strand")
    inn = bl.introns(ex)

    def end_of(x: Column, first: bool) -> Column:
        head, last = F.slice(x, 1, 1), F.slice(x, F.greatest(F.size(x), F.lit(1)), 1)
        return F.when(strand == "-", last if first else head).otherwise(head if first else last)

    args = (ex, F.col("cds_start"), F.col("cds_end"))
    kinds = {
        "all": lambda: F.array(bl.block(F.col("start"), F.col("end"))), "exons": lambda: ex, "introns": lambda: inn,
        "first_exon": lambda: end_of(ex, True), "last_exon": lambda: end_of(ex, False), "first_intron": lambda: end_of(inn, True), "last_intron": lambda: end_of(inn, False),
        "5utr": lambda: bl.utr5(*args, strand), "3utr": lambda: bl.utr3(*args, strand), "cds": lambda: bl.cds_exons(*args),
    }
    return tx.withColumn("blocks", kinds[kind]()).where(F.size("blocks") > 0)


def separate_blocks(regions: DataFrame) -> DataFrame:
    """C6 ``separate``: a row per block, counted in the direction of the strand."""
    way = F.when(F.col("strand") == "-", F.reverse("blocks")).otherwise(F.col("blocks"))
    return regions.select("*", F.size("blocks").alias("of"), F.posexplode(way).alias("_i", "_b")).withColumn("number", F.col("_i") + 1).withColumn("block_start", F.col("_b.start")).withColumn("block_end", F.col("_b.end")).drop("_i", "_b")


def lengths(tx: DataFrame) -> DataFrame:
    """F16: lengths and counts of exons, introns, CDS and UTRs."""
    ex, args = F.col("exons"), (F.col("exons"), F.col("cds_start"), F.col("cds_end"))
    inn = bl.introns(ex)
    return tx.withColumns({
        "length": F.col("end") - F.col("start"), "exons_len": bl.blocks_length(ex), "exons_count": F.size(ex), "introns_len": bl.blocks_length(inn), "introns_count": F.size(inn),
        "cds_len": bl.blocks_length(bl.cds_exons(*args)), "utr5_len": bl.blocks_length(bl.utr5(*args, F.col("strand"))), "utr3_len": bl.blocks_length(bl.utr3(*args, F.col("strand"))),
    })
