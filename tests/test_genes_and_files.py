"""Gene model, annotation, signal, reads, sequence functions and file formats against hand-derived results."""

import gzip
import math
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from spanweave.functions import blocks as bl
from spanweave.functions import sequence as sq
from spanweave.operators import annotate as an
from spanweave.operators import features as ft
from spanweave.operators import reads as rd
from spanweave.operators import signal as sg
from spanweave.operators import tables as tb
from spanweave.sources import binary, logs, sinks, text

GTF = """# head
chr1\tx\tgene\t101\t500\t.\t+\t.\tgene_id "G1"; gene_name "N1"; gene_type "protein_coding";
chr1\tx\ttranscript\t101\t500\t.\t+\t.\tgene_id "G1"; transcript_id "T1"; gene_name "N1"; gene_type "protein_coding"; transcript_type "protein_coding"; tag "a"; tag "b"; level 2;
# in between
chr1\tx\texon\t101\t200\t.\t+\t.\tgene_id "G1"; transcript_id "T1"; gene_name "N1"; gene_type "protein_coding"; transcript_type "protein_coding";
chr1\tx\tCDS\t151\t200\t.\t+\t.\tgene_id "G1"; transcript_id "T1";
chr1\tx\texon\t301\t500\t.\t+\t.\tgene_id "G1"; transcript_id "T1";
chr1\tx\tCDS\t301\t350\t.\t+\t.\tgene_id "G1"; transcript_id "T1";
chr1\tx\tstop_codon\t351\t353\t.\t+\t.\tgene_id "G1"; transcript_id "T1";
"""


@pytest.fixture(scope="module")
def gtf(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("gtf") / "a.gtf"
    p.write_text(GTF)
    return text.gtf(spark, str(p)).withColumn("record_id", F.monotonically_increasing_id())


@pytest.fixture(scope="module")
def tx(gtf):
    return ft.transcripts(gtf).cache()


def pairs(blocks):
    return [tuple(b) for b in blocks]


def test_attributes(gtf):
    r = gtf.where("feature = 'transcript'").first()
    assert r.attrs == {"gene_id": "G1", "transcript_id": "T1", "gene_name": "N1", "gene_type": "protein_coding", "transcript_type": "protein_coding", "tag": "a,b", "level": "2"}
    assert gtf.count() == 7
    got = gtf.select(text.attribute(F.col("attributes"), "tag").alias("t"), text.attribute(F.col("attributes"), "none").alias("n")).where("t IS NOT NULL").collect()
    assert [tuple(x) for x in got] == [("a,b", None)]
    assert gtf.where("feature = 'gene'").first().transcript_id == "G1"
    assert text.filter_features(gtf, ["exon"], transcript_id=["T1"]).count() == 2


def test_transcript(tx):
    t = tx.first()
    assert (t.start, t.end, t.cds_start, t.cds_end, pairs(t.exons)) == (100, 500, 150, 353, [(100, 200), (300, 500)])
    c = (F.col("exons"), F.col("cds_start"), F.col("cds_end"))
    r = tx.select(bl.introns(F.col("exons")).alias("i"), bl.utr5(*c, F.col("strand")).alias("u5"), bl.cds_exons(*c).alias("c"), bl.utr3(*c, F.col("strand")).alias("u3"), bl.start_codon(c[1], c[2], F.col("strand")).alias("s")).first()
    assert (pairs(r.i), pairs(r.u5), pairs(r.c), pairs(r.u3), tuple(r.s)) == ([(200, 300)], [(100, 150)], [(150, 200), (300, 353)], [(353, 500)], (150, 153))
    b = ft.bed12_rows(tx).first()
    assert (b.blockSizes, b.blockStarts, b.thickStart, b.thickEnd) == ("100,200,", "0,200,", 150, 353)
    minus = tx.withColumn("strand", F.lit("-"))
    r = minus.select(bl.utr5(*c, F.col("strand")).alias("u5"), bl.tss(F.col("start"), F.col("end"), F.col("strand")).alias("t")).first()
    assert (pairs(r.u5), r.t) == ([(353, 500)], 500)
    assert [pairs(x.blocks) for x in ft.region_blocks(minus, "first_exon").collect()] == [[(300, 500)]]
    assert [(x.number, x.block_start) for x in ft.separate_blocks(ft.region_blocks(minus, "exons")).orderBy("number").collect()] == [(1, 300), (2, 100)]
    assert [tuple(x) for x in ft.trans_info(ft_gtf(minus)).collect()] == []
    g = ft.genes(tx).first()
    assert (g.gene_id, g.start, g.end, pairs(g.exons)) == ("G1", 100, 500, [(100, 200), (300, 500)])


def ft_gtf(df):
    return df.limit(0).withColumn("feature", F.lit("")).withColumn("record_id", F.lit(1))


def test_annotation(spark, tx):
    f = tx.select(F.col("transcript_id").alias("id"), F.col("gene_name").alias("name"), F.col("transcript_type").alias("type"), "chrom", "start", "end", "strand", "cds_start", "cds_end", "exons")
    want = {(110, 120): "5UTR", (160, 170): "CDS", (220, 230): "Intron", (400, 410): "3UTR", (50, 60): "Upstream", (600, 610): "Downstream", (9000, 9010): "Intergenic", (99, 151): "5UTR"}
    reads = spark.createDataFrame([(i, "chr1", s, e, "+") for i, (s, e) in enumerate(want)], "id long, chrom string, start long, end long, strand string")
    assert {(r.start, r.end): r.anno for r in an.annotate(reads, f).collect()} == want
    mirrored = f.withColumn("strand", F.lit("-"))
    got = {(r.start, r.end): r.anno for r in an.annotate(reads, mirrored).collect()}
    assert (got[110, 120], got[400, 410], got[50, 60], got[600, 610]) == ("3UTR", "5UTR", "Downstream", "Upstream")
    points = an.annotate(spark.createDataFrame([(1, "chr1", 100, 101, "+"), (2, "chr1", 150, 151, "+"), (3, None, 1, 2, "+")], reads.schema), f, tss=True, tes=True, start_codon=True, stop_codon=True)
    assert {r.id: r.anno for r in points.collect()} == {1: "TSS", 2: "StartCondon", 3: "Intergenic"}
    assert {r.id: r.ids for r in an.annotate(reads, f, stranded=True, upstream_name="Promoter").where("anno = 'Promoter'").collect()} == {4: "T1"}


def test_loci(spark):
    t = spark.createDataFrame([("T1", "c", 0, 10, "+"), ("T2", "c", 10, 20, "+"), ("T3", "c", 50, 60, "+"), ("T4", "d", 5, 9, "+")], "transcript_id string, chrom string, start long, end long, strand string")
    for c in ("gene_id", "gene_name", "gene_type", "transcript_type"):
        t = t.withColumn(c, F.lit(c))
    t = t.withColumn("cds_start", F.lit(None).cast("long")).withColumn("cds_end", F.lit(None).cast("long")).withColumn("exons", F.array(bl.block(F.col("start"), F.col("end"))))
    sizes = spark.createDataFrame([("c", 100)], "chrom string, length long")
    got = sorted((r.chrom, r.start, r.end, r.transcript_id, r.before, r.after) for r in ft.with_distances(ft.loci(t), ["chrom", "strand"], sizes).collect())
    assert got == [("c", 0, 20, "T1,T2", 0, 30), ("c", 50, 60, "T3", 30, 40), ("d", 5, 9, "T4", 5, 0)]


def test_cigar_and_strands(spark):
    df = spark.createDataFrame([("5S10M2I3D4N6M", "-")], "c string, s string")
    r = df.select(bl.cigar_tuples(F.col("c")).alias("t"), bl.cigar_blocks(F.lit(100), bl.cigar_tuples(F.col("c"))).alias("b"), bl.fragment_strand(F.col("s"), "1+-,1-+,2++,2--", F.lit(False)).alias("f"), bl.fragment_strand(F.lit(None).cast("string"), "++,--", F.lit(True)).alias("n"), bl.runs_of_one(F.array(*map(F.lit, (1, 2, 3, 7, 9, 10)))).alias("runs")).first()
    assert [tuple(x) for x in r.t] == [(4, 5), (0, 10), (1, 2), (2, 3), (3, 4), (0, 6)]
    assert pairs(r.b) == [(100, 113), (117, 123)]
    assert (r.f, r.n, r.runs) == ("+", "+", [[1, 2, 3], [7], [9, 10]])


def test_sequences(spark):
    df = spark.createDataFrame([("aacgtnKr",)], "s string")
    r = df.select(sq.reverse_complement(F.col("s")).alias("rc"), sq.to_rna(F.lit("ac-gt?")).alias("rna"), sq.wrap(F.lit("a" * 120), 60).alias("w"), sq.motif_positions(F.lit("GATCGATTGA"), "GAT").alias("p"), sq.location(F.lit("chr1:5-20(-)")).alias("l"), sq.fetch_blocks(F.lit("ACGTACGT"), F.array(bl.block(F.lit(-2), F.lit(2)), bl.block(F.lit(6), F.lit(99))), F.lit("-")).alias("f")).first()
    assert (r.rc, r.rna, r.w.count("\n"), pairs(r.p), tuple(r.l), r.f) == ("YMNACGTT", "ACGU", 1, [(0, 3), (4, 7)], ("chr1", 5, 20, "-"), "ACGT")
    assert sq.pattern("AYN") == "A[CTU][ACGTU]"
    with pytest.raises(Exception, match="no complement"):
        df.select(sq.reverse_complement(F.lit("ACX!"))).collect()


def test_fastx(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@r1 c\nACGT\n+\nIIII\n@r2\nGG\n+\nII\n@r1\nACGT\n+\nIIII\n")
    fq = text.fastq(spark, str(tmp_path / "a.fq"))
    assert [(r._pos, r.name, r.comment, r.sequence) for r in fq.orderBy("_pos").collect()] == [(0, "r1", "c", "ACGT"), (1, "r2", None, "GG"), (2, "r1", None, "ACGT")]
    assert [r.name for r in rd.dedup_sequences(fq, ["sequence"]).orderBy("_pos").collect()] == ["r1", "r2"]
    assert [r.name for r in rd.rename_duplicates(fq, "name").orderBy("_pos").collect()] == ["r1", "r2", "r1_2"]
    sinks.write_lines(sinks.fastq_text(fq.drop("quality").orderBy("_pos")), str(tmp_path / "out"), gzip=True)
    again = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "out").glob("*.gz"))).decode()
    assert sorted(again.split("@")[1:]) == sorted(["r1 c\nACGT\n+\nFFFF\n", "r2\nGG\n+\nFF\n", "r1\nACGT\n+\nFFFF\n"])
    (tmp_path / "g.fa").write_text(">c1 x y\nACGT\nAC\n>c2\nGG\n")
    fa = text.fasta(spark, str(tmp_path / "g.fa"))
    assert sorted((r.name, r.comment, r.sequence) for r in fa.collect()) == [("c1", "x y", "ACGTAC"), ("c2", None, "GG")]
    assert sorted(tuple(r) for r in text.chrom_lengths(fa).collect()) == [("c1", 6), ("c2", 2)]
    assert [r.name for r in sinks.choose_records(fa, ["c2", "c1"]).collect()] == ["c2", "c1"]
    z = rd.zip_pairs(fq.where("_pos < 2"), fq, check=True)
    assert z.count() == 2
    with pytest.raises(Exception, match="names differ"):
        rd.zip_pairs(fq, fq.withColumn("name", F.lit("q"))).collect()


RECORDS = [("q1", 99, "c1", 5, 60, "4M", "ACGT", "IIII"), ("q1", 147, "c1", 20, 60, "2M1D2M", "GGTT", "JJJJ"), ("q2", 77, None, -1, 0, "*", "ACG", "III"), ("q3", 73, "c2", 3, 20, "3M", "ACG", "*")]


def test_bam_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(RECORDS, "qname string, flag int, rname string, pos bigint, mapq int, cigar string, seq string, qual string").coalesce(1)
    binary.write_bam(rows, str(tmp_path / "a.bam"), [("c1", 100), ("c2", 50)])
    df = spark.read.format("spanweave_bam").load(str(tmp_path / "a.bam"))
    assert sorted(tuple(r)[1:] for r in df.collect()) == sorted(RECORDS)
    assert rd.bam_type(df).first()[0] == "PE"
    assert rd.usable(df).count() == 3 and rd.mapped(df, least_mapq=30).count() == 2 and rd.unmapped(df).count() == 1
    p = rd.mate_pairs(df, "qname", F.when(rd.has(rd.READ1), 1).otherwise(2), "_pos", ["_pos", "rname", "seq"])
    assert sorted(r.qname for r in rd.unpaired(p).collect()) == ["q2", "q3"]
    assert sorted(tuple(r) for r in rd.reference_count(p, "rname").collect()) == [("c1", 1), ("c2", 1)]
    assert [(r.category, r.qname, r.mate) for r in rd.name_order(p, "qname").collect()] == [(0, "q1", 1), (0, "q1", 2), (1, "q2", 1), (1, "q3", 1)]
    assert {r.name: r.sequence for r in rd.to_fastx(df.where("flag = 147")).collect()} == {"q1": "AACC"}
    sinks.write_lines(sinks.sam_text(df), str(tmp_path / "sam"))
    sam = text.sam(spark, str(tmp_path / "sam"))
    assert sorted((r.qname, r.flag, r.rname or "", r.pos, r.cigar) for r in sam.collect()) == sorted((a, b, c or "", d, f) for a, b, c, d, _, f, _, _ in RECORDS)
    assert pairs(rd.with_blocks(df.where("flag = 147")).first().blocks) == [(20, 25)]


def write_bigwig(path, rows):
    """One zipped bedGraph block of one chromosome."""
    block = struct.pack("<IIIIIBBH", 0, rows[0][0], rows[-1][1], 0, 0, 1, 0, len(rows)) + b"".join(struct.pack("<IIf", *r) for r in rows)
    data = zlib.compress(block)
    tree = struct.pack("<IIIIQQ", 0x78CA8C91, 1, 4, 8, 1, 0) + struct.pack("<BBH", 1, 0, 1) + b"chr1" + struct.pack("<II", 0, 1000)
    at = 64 + len(tree)
    index = struct.pack("<IIQIIIIQII", 0x2468ACE0, 1, 1, 0, 0, 0, 1000, 0, 1, 0) + struct.pack("<BBH", 1, 0, 1) + struct.pack("<IIIIQQ", 0, 0, 0, 1000, at, len(data))
    head = struct.pack("<IHHQQQHHQQIQ", 0x888FFC26, 4, 0, 64, at, at + len(data), 0, 0, 0, 0, 4096, 0)
    path.write_bytes(head + tree + data + index)


def test_bigwig(spark, tmp_path):
    write_bigwig(tmp_path / "s1.bw", [(0, 10, 1.5), (10, 12, 2.0), (50, 60, 4.0)])
    binary.register(spark)
    df = spark.read.format("spanweave_bigwig").load(str(tmp_path / "s1.bw"))
    assert [tuple(r) for r in df.collect()] == [("s1", "chr1", 0, 10, 1.5), ("s1", "chr1", 10, 12, 2.0), ("s1", "chr1", 50, 60, 4.0)]
    assert binary.bigwig_chroms(str(tmp_path / "s1.bw")) == {"chr1": 1000}


@pytest.fixture(scope="module")
def track(spark):
    return spark.createDataFrame([("s", "c", 0, 10, 1.0), ("s", "c", 12, 15, 3.0), ("s", "c", 30, 31, -2.0)], "sample string, chrom string, start long, end long, value double")


def dense(lo, hi):
    y = [0.0] * 200
    for s, e, v in ((0, 10, 1.0), (12, 15, 3.0), (30, 31, -2.0)):
        y[s:e] = [v] * (e - s)
    return [y[i] if i >= 0 else 0.0 for i in range(lo, hi)]


def test_signal(spark, track):
    reg = spark.createDataFrame([(1, "c", 5, 35), (2, "c", 100, 110), (3, "d", 0, 4)], "id long, chrom string, start long, end long")
    y = dense(5, 35)
    got = [r.value for r in sg.values(reg, track).where("id = 1").orderBy("pos").collect()]
    assert got == y
    r = sg.stats(reg, track).where("id = 1").first()
    on = y[:5] + y[7:10] + [y[25]]
    mean = sum(on) / len(on)
    assert (r["sum"], r.max, r.min, round(r["mean"], 9), round(r.coverage, 9)) == (sum(y), 3.0, -2.0, round(mean, 9), round(len(on) / 30, 9))
    assert math.isclose(r["std"], (sum((x - mean) ** 2 for x in on) / (len(on) - 1)) ** 0.5)
    assert sg.stats(reg, track).where("id = 2").first()["max"] == 0.0
    got = [r.value for r in sg.coverage_bins(reg.where("id = 1"), track, 6).orderBy("bin").collect()]
    assert got == [sum(v != 0 for v in y[i : i + 5]) / 5 for i in range(0, 30, 5)]
    got = [round(r.value, 9) for r in sg.scale_region(reg.where("id = 1"), track, 40, 10).orderBy("bin").collect()]
    assert got == [round(sum(y[i : i + 7]) / 7, 9) for i in range(0, 28, 7)]
    got = [r.value for r in sg.sliding_coverage(reg.where("id = 1"), track, 4).orderBy("pos").collect()]
    assert got == [sum(v != 0 for v in y[i : i + 4]) / 4 for i in range(27)]


def test_profiles(spark, track):
    loci = spark.createDataFrame([(1, "c", 10, 30, "+"), (2, "c", 4, 14, "-")], "id long, chrom string, start long, end long, strand string")
    got = [r.value for r in sg.signal_point(loci, track, "TSS", 8, 6).orderBy("bin").collect()]
    a, b = dense(2, 16), dense(8, 22)[::-1]
    assert got == [(x + y) / 2 for x, y in zip(a, b)]
    got = [r.value for r in sg.reference_point(loci, track, "TES", "reads", 8, 8, 4).orderBy("bin").collect()]
    a, b = dense(22, 38), dense(-4, 12)[::-1]
    assert got == [(sum(a[i : i + 4]) + sum(b[i : i + 4])) / 8 for i in range(0, 16, 4)]
    got = [r.value for r in sg.scale_regions(loci, track, 4, 8, 10, 2).orderBy("bin").collect()]

    def one(s, e, flip):
        up, down = (8, 4) if flip else (4, 8)
        n = (e - s) // 5
        bins = [sum(dense(s - up, s)[i : i + 2]) / 2 for i in range(0, up, 2)] + [sum(dense(s, e)[i * n : i * n + n]) / n for i in range(5)] + [sum(dense(e, e + down)[i : i + 2]) / 2 for i in range(0, down, 2)]
        return bins[::-1] if flip else bins

    assert [round(x, 9) for x in got] == [round((x + y) / 2, 9) for x, y in zip(one(10, 30, False), one(4, 14, True))]
    flat = sg.signal_point(loci, track, "TSS", 8, 6).withColumn("value", F.col("bin") * F.col("bin") * 1.0)
    assert [round(r.value, 6) for r in sg.smooth(flat, 5, 2).orderBy("bin").collect()] == [float(i * i) for i in range(14)]


def test_normalising(spark):
    df = spark.createDataFrame([("g1", 1000.0, 10.0), ("g2", 2000.0, 30.0), ("g3", 500.0, 0.0)], "Gene string, Length double, s double")
    for method, want in (("CPM", {"g1": 250000.0, "g2": 750000.0}), ("RPKM", {"g1": 250000.0, "g2": 375000.0}), ("TPM", {"g1": 400000.0, "g2": 600000.0})):
        assert {r.Gene: r.s for r in tb.normalise(df, ["s"], method).collect()} == want


def test_tests():
    assert math.isclose(tb.t_test([1, 2, 3, 4.0], [2, 3, 4, 5.0])[1], 0.3153, abs_tol=1e-3)
    assert math.isclose(tb._beta(0.5, 2, 3), 0.6875, abs_tol=1e-12)


def test_strand_inference_and_containment(spark):
    reads = spark.createDataFrame([(1, "c", 0, 5, "+", 1), (2, "c", 0, 5, "-", 2), (3, "c", 0, 5, "-", 1), (4, "c", 90, 95, "+", 1)], "id long, chrom string, start long, end long, strand string, mate int")
    genes = spark.createDataFrame([("c", 0, 50, "+")], "chrom string, start long, end long, strand string")
    r = rd.strand_inference(reads, genes).first()
    assert (r.n, round(r.sense, 3), round(r.antisense, 3), r.undecided) == (3, 0.667, 0.333, 0.0)
    rng = random.Random(1)
    seqs = [(str(i), "".join(rng.choices("AC", k=rng.randint(1, 12)))) for i in range(40)]
    df = spark.createDataFrame(seqs, "id string, sequence string")
    got = {(r.id_a, r.id_b) for r in rd.containment(df, df, 3).collect()}
    assert got == {(a, b) for a, x in seqs for b, y in seqs if y in x}
    tops = {r.sequence for r in rd.merge_subsequences(df, 3).collect()}
    every = {x for _, x in seqs}
    assert tops == {x for x in every if not any(x != y and x in y for y in every)}


def test_logs(spark, tmp_path):
    (tmp_path / "s1_1.log").write_text("Total read pairs processed:     1,234\n  Read 1 with adapter:    123 (10.0%)\n  Read 2 with adapter:    12 (1.0%)\n")
    r = logs.cutadapt(logs.read(spark, str(tmp_path / "s1_1.log"))).first()
    assert tuple(r) == ("s1_1", "1234", "123", "10.0%", "12", "1.0%")
    (tmp_path / "s2.log").write_text("100 reads; of these:\n x\n y\n 30 (30%) one\n 20 (20%) more\n50.00% overall alignment rate\n")
    assert tuple(logs.bowtie2(logs.read(spark, str(tmp_path / "s2.log"))).first()) == ("s2", "100", "50", "50.00%")
    (tmp_path / "s3.log").write_text("10 + 0 in total\n8 + 0 properly paired (80%)\n")
    assert tuple(logs.flagstat(logs.read(spark, str(tmp_path / "s3.log"))).first()) == ("s3", "4")
    (tmp_path / "s4.log").write_text("  Number of input reads |\t10\n Uniquely mapped reads number |\t5\n Uniquely mapped reads % |\t50.00%\n Number of reads mapped to multiple loci |\t2\n % of reads mapped to multiple loci |\t20.00%\n")
    assert tuple(logs.star(logs.read(spark, str(tmp_path / "s4.log"))).first()) == ("s4", "10", "5", "50.00%", "2", "20.00%", "7", "70.00%")
    parts = logs.sample_parts(spark.createDataFrame([("liver_rep2",), ("heart-1",), ("x",)], "samples string")).collect()
    assert [(p.replicates, p.group) for p in parts] == [("rep2", "liver"), ("rep1", "heart"), ("rep0", "x")]


def test_tables_and_text_files(spark, tmp_path):
    (tmp_path / "a.bed").write_text("c\t1\t5\nc\t2\t9\tn\t0\t-\textra\n\n")
    assert [(r.start, r.end, r.name, r.strand) for r in text.bed6(spark, str(tmp_path / "a.bed")).collect()] == [(1, 5, "", "+"), (2, 9, "n", "-")]
    (tmp_path / "b.bed").write_text("c\t100\t500\tT\t0\t+\t150\t353\t0\t2\t100,200,\t0,200,\n")
    assert pairs(text.bed12(spark, str(tmp_path / "b.bed")).first().blocks) == [(100, 200), (300, 500)]
    (tmp_path / "s.bedgraph").write_text("track x\nc 0 5 1.5\n")
    assert tuple(text.bedgraph(spark, str(tmp_path / "s.bedgraph")).first()) == ("s", "c", 0, 5, 1.5)
    (tmp_path / "n.txt").write_text("a b\n c\n")
    assert sorted(r.name for r in text.name_list(spark, str(tmp_path / "n.txt")).collect()) == ["a", "b", "c"]
    (tmp_path / "counts.txt").write_text("# x\nGeneid\tChr\tStart\tEnd\tStrand\tLength\t/p/s1.sorted.bam\ng\tc\t1\t2\t+\t100\t7\n")
    c = text.feature_counts(spark, str(tmp_path / "counts.txt"))
    assert c.columns == ["Gene", "Length", "s1"] and tuple(c.first()) == ("g", 100, 7)
    spikes = spark.createDataFrame([("E1", "ACGT")], "ERCC_ID string, Sequence string")
    fa, rows = rd.spike_ins(spikes)
    assert fa.first().sequence == "ACGT" and [r.feature for r in rows.collect()] == ["gene", "transcript", "exon"]
    with pytest.raises(ValueError, match="spreadsheets"):
        text.table(spark, "x.xlsx")
    assert rd.exact_sample(spark.range(100), 7, "id").count() == 7


def test_annotated_fragments(spark):
    rows = [
        (1, "a", 0x1 | 0x40, "c", 100, 60, "20M", "", ""), (2, "a", 0x1 | 0x80, "c", 110, 60, "20M10N5M", "", ""),  # overlap on one strand: a fragment
        (3, "b", 0x41, "c", 100, 60, "20M", "", ""), (4, "b", 0x81 | 0x10, "c", 110, 60, "20M", "", ""),  # other strands
        (5, "d", 0x41, "c", 900, 60, "10M", "", ""),  # alone
        (6, "e", 0x41 | 0x4, "c", 900, 60, "10M", "", ""), (7, None, 0x41, "c", 1, 60, "1M", "", ""), (8, "f", 0x41, "c", 5, 60, "*", "", ""),
    ]
    al = spark.createDataFrame(rows, "_pos bigint, qname string, flag int, rname string, pos bigint, mapq int, cigar string, seq string, qual string")
    got = {(r.id, r.qname, r.start, r.end, r.strand, tuple(pairs(r.blocks))) for r in an.fragments(al, paired=True).collect()}
    assert got == {(1, "a", 100, 145, "-", ((100, 130), (140, 145))), (3, "b", 100, 120, "-", ((100, 120),)), (4, "b", 110, 130, "-", ((110, 130),)), (5, "d", 900, 910, "-", ((900, 910),))}
    alone = {(r.id, r.strand) for r in an.fragments(al, "++,--").where("qname IS NOT NULL").collect()}
    assert alone == {(1, "+"), (2, "-"), (3, "+"), (4, "+"), (5, "+")}
    f = spark.createDataFrame([("T", "N", "lncRNA", "protein_coding", "c", 90, 200, "-", None, None, [(90, 200)])], f"id string, name string, type string, gene_type string, chrom string, start long, end long, strand string, cds_start long, cds_end long, exons {bl.BLOCKS}")
    out = {r.qname: (r.anno, r.types) for r in an.annotate_alignments(al, f, paired=True, region=(-10, 0), down=10).collect()}
    assert out == {"a": ("Exon", "lncRNA"), "b": ("Exon", "lncRNA"), "d": ("Intergenic", "*")}
    assert {r.types for r in an.annotate_alignments(al, f.withColumn("gene_type", F.lit("x")), paired=True).where("qname = 'a'").collect()} == {"x"}
    assert an.fragments(al.limit(0), paired=True).count() == 0
