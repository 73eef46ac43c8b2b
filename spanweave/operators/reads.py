"""Alignments and sequence records.

Alignments have qname, flag, rname, pos, mapq, cigar, seq, qual and a unique order column. Sequence records have name, sequence, quality, comment and ``_pos``.
Defined results: null names pair with nothing; the last record of a mate wins; ties do not occur, as order columns are unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.functions import blocks as bl
from spanweave.functions.sequence import reverse_complement
from spanweave.operators.intervals import overlap_join
from spanweave.runtime import attach

#: Bits of the alignment flag.
PAIRED, UNMAPPED, REVERSE, READ1, READ2, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 0x1, 0x4, 0x10, 0x40, 0x80, 0x100, 0x200, 0x400, 0x800


def has(bits: int, flag: str = "flag") -> Column:
    return F.col(flag).bitwiseAND(F.lit(bits)) != 0


def bam_type(df: DataFrame, order: str = "_pos") -> DataFrame:
    """One row, PE or SE, by the first record; none for an empty table."""
    return df.orderBy(order).limit(1).select(F.when(has(READ1 | READ2), "PE").otherwise("SE").alias("kind"))


def usable(df: DataFrame) -> DataFrame:
    """S15 "all": mapped, primary, not failed, no duplicate."""
    return df.where(~has(UNMAPPED | SECONDARY | QC_FAIL | DUPLICATE))


def by_flags(df: DataFrame, flags: list[int] | None = None, remove_flags: list[int] | None = None, secondary: bool = False, supplementary: bool = False, only_mapped: bool = True) -> DataFrame:
    """Flag values in and not in lists, and by kind."""
    out = df
    for keep, bit in ((secondary, SECONDARY), (supplementary, SUPPLEMENTARY), (not only_mapped, UNMAPPED)):
        if not keep:
            out = out.where(~has(bit))
    if flags:
        out = out.where(F.col("flag").isin(flags))
    return out.where(~F.col("flag").isin(remove_flags)) if remove_flags else out


def mapped(df: DataFrame, secondary: bool = False, supplementary: bool = False, least_mapq: int | None = None) -> DataFrame:
    """S17."""
    drop = UNMAPPED | QC_FAIL | DUPLICATE | (0 if secondary else SECONDARY) | (0 if supplementary else SUPPLEMENTARY)
    out = df.where(~has(drop))
    return out if least_mapq is None else out.where(F.col("mapq") >= least_mapq)


def unmapped(df: DataFrame) -> DataFrame:
    """S18."""
    return df.where(has(UNMAPPED) & ~has(SECONDARY | SUPPLEMENTARY | QC_FAIL))


def with_blocks(df: DataFrame) -> DataFrame:
    """``blocks`` of each alignment and its ``strand``."""
    return df.withColumn("blocks", bl.cigar_blocks(F.col("pos"), bl.cigar_tuples(F.col("cigar")))).withColumn("strand", F.when(has(REVERSE), "-").otherwise("+"))


def mate_pairs(df: DataFrame, name: str, mate: Column, order: str, columns: list[str]) -> DataFrame:
    """One row per name with structs ``r1`` and ``r2`` (null where that mate is absent); the last record of a mate wins. One aggregation instead of a self-join."""
    rec = F.struct(*columns)
    keyed = df.withColumn("_mate", mate).where(F.col(name).isNotNull())
    return keyed.groupBy(name).agg(*[F.max_by(rec, F.when(F.col("_mate") == m, F.col(order))).alias(f"r{m}") for m in (1, 2)]).where("r1 IS NOT NULL OR r2 IS NOT NULL")


def unpaired(pairs: DataFrame) -> DataFrame:
    """Names with one mate only, and which."""
    return pairs.where("r1 IS NULL OR r2 IS NULL").withColumn("mate", F.when(F.col("r1").isNotNull(), 1).otherwise(2))


def name_order(pairs: DataFrame, name: str) -> DataFrame:
    """Records as a name-grouped file has them: pairs first, then lone first mates, then lone second ones; sort by ``category``, name and ``mate``."""
    kind = F.when(F.col("r1").isNotNull() & F.col("r2").isNotNull(), 0).when(F.col("r1").isNotNull(), 1).otherwise(2)
    both = F.array(F.struct(F.lit(1).alias("mate"), F.col("r1").alias("r")), F.struct(F.lit(2).alias("mate"), F.col("r2").alias("r")))
    rows = pairs.select(name, kind.alias("category"), F.explode(both).alias("x")).where("x.r IS NOT NULL")
    return rows.select("category", name, "x.mate", "x.r.*").orderBy("category", name, "mate")


def reference_count(pairs: DataFrame, ref: str) -> DataFrame:
    """Fragments per reference; a pair on one reference counts once there, on two once each."""
    refs = F.array_distinct(F.filter(F.array(F.col(f"r1.{ref}"), F.col(f"r2.{ref}")), lambda x: x.isNotNull()))
    return pairs.select(F.explode(refs).alias("ref")).groupBy("ref").agg(F.count("*").alias("n"))


def length_histogram(df: DataFrame, length: Column) -> DataFrame:
    """How many records have each length."""
    return df.select(length.alias("length")).where("length IS NOT NULL").groupBy("length").agg(F.count("*").alias("n"))


def read_strandness(reads: DataFrame, genes: DataFrame) -> DataFrame:
    """Id, mate, strand, ``gene`` (strands of the genes that the read meets, joined by ``:``) and ``kind`` (sense, antisense, undecided) of each read that meets a gene.

    ``reads``: chrom, start, end, strand, mate (0, 1, 2) and a unique ``id``; a read over genes of both strands is undecided.
    """
    hits = overlap_join(reads, genes.select("chrom", "start", "end", "strand"), ["chrom"]).groupBy("id", "mate", "strand").agg(F.array_join(F.array_sort(F.collect_set("strand_b")), ":").alias("gene"))
    code = F.concat(F.when(F.col("mate") > 0, F.col("mate").cast("string")).otherwise(""), "strand", "gene")
    same = code.isin("1++", "1--", "2+-", "2-+", "++", "--")
    other = code.isin("1+-", "1-+", "2++", "2--", "+-", "-+")
    return hits.withColumn("kind", F.when(same, "sense").when(other, "antisense").otherwise("undecided"))


def strand_inference(reads: DataFrame, genes: DataFrame, sample: int | None = None, order: str = "id") -> DataFrame:
    """One row: how many reads meet a gene, and the fractions of the two strand rules and of reads that tell nothing. ``sample`` takes the first such reads by ``id``."""
    hits = read_strandness(reads, genes)
    if sample is not None:
        hits = hits.orderBy(order).limit(sample)  # a top-k of short rows
    n = F.count("*")
    return hits.agg(n.alias("n"), *[(F.count_if(F.col("kind") == k) / n).alias(k) for k in ("sense", "antisense", "undecided")])


def dedup_sequences(df: DataFrame, by: list[str], order: str = "_pos", min_length: int | None = None, sequences: list[str] | None = None) -> DataFrame:
    """The first record of each exact key, then those whose sequences all have ``min_length``."""
    from spanweave.operators.flow import dedup

    out = dedup(df, by, order)
    for s in sequences or [] if min_length else []:
        out = out.where(F.length(s) >= min_length)
    return out


def dedup_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """A10: records in and out, and the share dropped."""
    a, b = before.agg(F.count("*").alias("n_in")), after.agg(F.count("*").alias("n_out"))
    return a.transform(attach, b).withColumn("dropped", (F.col("n_in") - F.col("n_out")) / F.col("n_in"))


def rename_duplicates(df: DataFrame, name: str, order: str = "_pos", block: int = 4096) -> DataFrame:
    """The n-th record of a name becomes ``name_n``, the first keeps its name. Ordinals come from ranges of positions, so one frequent name is many tasks."""
    from pyspark.sql import Window

    part = df.withColumn("_block", F.expr(f"`{order}` div {block}"))
    sizes = part.groupBy(name, "_block").count()
    before = sizes.select(F.col(name).alias("_name"), F.col("_block").alias("_b"), (F.sum("count").over(Window.partitionBy(name).orderBy("_block")) - F.col("count")).alias("_before"))
    k = F.row_number().over(Window.partitionBy(name, "_block").orderBy(order))
    ranked = part.withColumn("_k", k).join(before, F.col(name).eqNullSafe(F.col("_name")) & (F.col("_block") == F.col("_b"))).withColumn("_k", F.col("_k") + F.col("_before"))
    return ranked.withColumn(name, F.when(F.col("_k") > 1, F.concat(name, F.lit("_"), F.col("_k").cast("string"))).otherwise(F.col(name))).select(*df.columns)


def zip_pairs(r1: DataFrame, r2: DataFrame, order: str = "_pos", name: str = "name", check: bool = True) -> DataFrame:
    """Records of two files at equal positions, up to the shorter; names that differ before ``/`` raise."""
    b = r2.select(F.col(order), *[F.col(c).alias(c + "_2") for c in r2.columns if c != order])
    out = r1.join(b, order)
    if not check:
        return out
    same = F.substring_index(name, "/", 1) == F.substring_index(name + "_2", "/", 1)
    return out.withColumn(name, F.when(same, F.col(name)).otherwise(F.raise_error(F.concat(F.lit("names differ: "), name, F.lit(" "), name + "_2"))))


def reverse_records(df: DataFrame) -> DataFrame:
    """reverse complement with reversed quality."""
    return df.withColumn("sequence", reverse_complement(F.col("sequence"), False)).withColumn("quality", F.reverse("quality"))


def join_mates_fastq(pairs: DataFrame, rule_reverse: int = 2) -> DataFrame:
    """C7, own part: both mates in one file, the mate ``rule_reverse`` turned over, names with _R1 and _R2."""
    def one(i: int) -> DataFrame:
        r = pairs.where(f"r{i} IS NOT NULL").select(F.concat("name", F.lit(f"_R{i}")).alias("name"), f"r{i}.sequence", f"r{i}.quality")
        return reverse_records(r) if i == rule_reverse else r

    return one(1).unionByName(one(2))


def to_fastx(df: DataFrame) -> DataFrame:
    """C4: reads as sequenced: alignments on the minus strand turned over."""
    minus = has(REVERSE)
    return df.select(
        F.col("qname").alias("name"),
        F.when(minus, reverse_complement(F.col("seq"), False)).otherwise(F.col("seq")).alias("sequence"),
        F.when(minus, F.reverse("qual")).otherwise(F.col("qual")).alias("quality"),
    )


def containment(a: DataFrame, b: DataFrame, k: int = 16, key: str = "id", sequence: str = "sequence") -> DataFrame:
    """Pairs where the sequence of b lies in that of a. The first ``k`` letters of b, or all of a shorter one, are looked up among the words of a of the same lengths (``k`` at the most)."""
    bb = b.select(F.col(key).alias("id_b"), F.col(sequence).alias("sequence_b")).where("sequence_b IS NOT NULL AND sequence_b <> ''")
    size = F.least(F.length("sequence_b"), F.lit(k))
    bb = bb.withColumn("_w", F.substring(F.col("sequence_b"), F.lit(1), size))
    sizes = bb.agg(F.coalesce(F.collect_set(size), F.array().cast("array<int>")).alias("_sizes"))
    aa = a.select(F.col(key).alias("id_a"), F.col(sequence).alias("sequence_a")).where("sequence_a IS NOT NULL AND sequence_a <> ''").transform(attach, sizes)
    usable = F.filter("_sizes", lambda n: n <= F.length("sequence_a"))
    words = F.flatten(F.transform(usable, lambda n: F.transform(F.sequence(F.lit(1), F.length("sequence_a") - n + 1), lambda i: F.substring(F.col("sequence_a"), i, n))))
    words = aa.select("id_a", "sequence_a", F.explode(F.array_distinct(words)).alias("_w"))
    return words.join(bb, "_w").where(F.contains("sequence_a", "sequence_b")).select("id_a", "id_b", "sequence_a", "sequence_b")


def isoforms(pairs: DataFrame) -> DataFrame:
    """Pairs of ``containment`` classed by where the shorter lies: extra letters on the left (L), right (R) or both."""
    at = F.call_function("instr", F.col("sequence_a"), F.col("sequence_b"))
    left, right = at - 1, F.length("sequence_a") - F.length("sequence_b") - at + 1
    kind = F.when((left > 0) & (right > 0), "53").when(left > 0, "5").when(right > 0, "3").otherwise("same")
    extra = F.when((left > 0) & (right > 0), "LR").when(left > 0, "L").when(right > 0, "R").otherwise("")
    return pairs.withColumn("left", left).withColumn("right", right).withColumn("kind", kind).withColumn("extra", extra)


def collapse_containment(pairs: DataFrame) -> DataFrame:
    """Of each maximal record (contained nowhere) its parts and their parts, one hop on; parts sorted."""
    p = pairs.where("id_a <> id_b").select("id_a", "id_b").distinct()
    tops = p.select(F.col("id_a")).distinct().join(p.select(F.col("id_b").alias("id_a")).distinct(), "id_a", "left_anti")
    direct = tops.join(p, "id_a")
    further = direct.select("id_a", F.col("id_b").alias("m")).join(p.select(F.col("id_a").alias("m"), "id_b"), "m").select("id_a", "id_b")
    return direct.unionByName(further).groupBy("id_a").agg(F.array_sort(F.collect_set("id_b")).alias("parts"))


def merge_subsequences(df: DataFrame, k: int = 16, key: str = "id", sequence: str = "sequence") -> DataFrame:
    """sequences that lie in no other one, each with the names of all that lie in it, sorted and joined by ``;``; equal sequences are one, under the smallest name."""
    same = df.where(F.col(sequence).isNotNull()).groupBy(F.col(sequence).alias("sequence")).agg(F.min(key).alias("id"), F.array_sort(F.collect_set(key)).alias("names"))
    pairs = containment(same, same, k, "id", "sequence").where("id_a <> id_b").select("id_a", "id_b")
    tops = same.join(pairs.select(F.col("id_b").alias("id")).distinct(), "id", "left_anti")
    inner = pairs.join(same.select(F.col("id").alias("id_b"), F.col("names").alias("inner")), "id_b").groupBy(F.col("id_a").alias("id")).agg(F.flatten(F.collect_list("inner")).alias("inner"))
    out = tops.join(inner, "id", "left").withColumn("names", F.array_sort(F.array_distinct(F.concat("names", F.coalesce("inner", F.array().cast(same.schema["names"].dataType))))))
    return out.select("id", "sequence", F.array_join(F.transform("names", lambda x: x.cast("string")), ";").alias("names"))


def exact_sample(df: DataFrame, n: int, order: str, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows (or all, if fewer), without replacement, in the given order."""
    return df.withColumn("_r", F.xxhash64(F.lit(seed), F.col(order))).orderBy("_r", order).limit(n).drop("_r").orderBy(order)


def random_regions(spark_df: DataFrame, n: int, length: int = 50, seed: int = 0, name: str = "chrom", size: str = "length") -> DataFrame:
    """``n`` regions: chromosome (each as likely), strand and start uniform. The chromosome table is small: one row each."""
    spark = spark_df.sparkSession
    from pyspark.sql import Window

    chroms = spark_df.where(F.col(size) > length).select(F.col(name).alias("chrom"), F.col(size).alias("_size"), (F.row_number().over(Window.orderBy(name)) - 1).alias("_i"))
    total = chroms.agg(F.count("*").alias("_c"))
    rows = spark.range(n).withColumn("_u", F.rand(seed)).withColumn("_v", F.rand(seed + 1)).withColumn("_w", F.rand(seed + 2)).transform(attach, total)
    rows = rows.withColumn("_i", F.floor(F.col("_u") * F.col("_c")).cast("int")).join(F.broadcast(chroms), "_i")
    start = F.floor(F.col("_v") * (F.col("_size") - length))
    return rows.select("id", "chrom", start.alias("start"), (start + length).alias("end"), F.when(F.col("_w") < 0.5, "+").otherwise("-").alias("strand"))


def spike_ins(df: DataFrame, name: str = "ERCC_ID", sequence: str = "Sequence", source: str = "ERCC") -> tuple[DataFrame, DataFrame]:
    """(FASTA records, GTF rows) of a spike-in table: gene, transcript and exon over the whole sequence."""
    fasta = df.select(F.col(name).alias("name"), F.trim(sequence).alias("sequence"))
    rows = fasta.select("name", F.length("sequence").alias("end"), F.posexplode(F.array(*map(F.lit, ("gene", "transcript", "exon")))).alias("_i", "feature"))
    gene, tx = F.format_string('gene_id "%s";', "name"), F.format_string('gene_id "%s"; transcript_id "%s";', "name", "name")
    gtf = rows.select(F.col("name").alias("seqname"), F.lit(source).alias("source"), "feature", F.lit(1).cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), F.lit(".").alias("score"), F.lit("+").alias("strand"), F.lit(".").alias("frame"), F.when(F.col("feature") == "gene", gene).otherwise(tx).alias("attributes"))
    return fasta, gtf
