"""Queries over small tables, against brute force on every row: nothing is left out."""

import random

import pytest

import __spark_entry__ as entry

REGIONS = [(1, "c1", 11, 1300, "+"), (2, "c1", 301, 700, "-"), (3, "c1", 400, 505, "+"), (4, "c2", 1, 95, "-"), (5, "c3", 1, 1237, "+"), (6, "c1", 5, 11, "+"), (7, "c1", 101, 600, "-")]


def bed6():
    rng = random.Random(3)
    rows = []
    for i in range(90):
        s = rng.randint(0, 1280)
        rows.append((i, rng.choice(["c1", "c1", "c2"]), s, s + rng.choice([0, 1, 2, 9, 40, 130]), rng.choice(["+", "-", "."])))
    return rows


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    gtf = [(i, c, "transcript", s, e, t) for i, c, s, e, t in REGIONS] + [(90, "c1", "exon", 1, 9, "+"), (91, "c1", "transcript", 1, 9, None), (92, None, "transcript", 1, 9, "+")]
    spark.createDataFrame(gtf, "record_id long, seqname string, feature string, start long, end long, strand string").write.parquet(f"{d}/gtf.parquet")
    spark.createDataFrame(bed6(), "interval_id long, chrom string, start long, end long, strand string").write.parquet(f"{d}/bed6.parquet")
    return str(d)


def depths():
    """id, sample: the depth at every base of a transcript."""
    out = {}
    for i, c, s, e, _ in REGIONS:
        for sample in "+-":
            out[i, sample] = [sum(b[1] == c and b[4] == sample and b[2] <= x < b[3] for b in bed6()) for x in range(s - 1, e)]
    return out


def test_signal_values_of_every_base(spark, tables):
    rows = entry.queries()["signal_values"](spark, tables).collect()
    got = {(r.id, r["sample"], r.pos): r.value for r in rows}
    assert got == {(*k, p): float(v) for k, y in depths().items() for p, v in enumerate(y)}
    assert len(got) == len(rows)


def test_signal_sliding_at_every_position(spark, tables):
    rows = entry.queries()["signal_sliding"](spark, tables).collect()
    got = {(r.id, r["sample"], r.pos): r.value for r in rows}
    assert got == {(*k, p): sum(v != 0 for v in y[p : p + 100]) / 100 for k, y in depths().items() for p in range(len(y) - 99)}
    assert len(got) == len(rows)


def test_coverage_bins_of_whole_regions(spark, tables):
    got = {(r.id, r["sample"], r.bin): r.value for r in entry.queries()["signal_coverage_bins"](spark, tables).collect()}
    want = {}
    for k, y in depths().items():
        tenths = [v != 0 for v in y for _ in range(10)]  # a base as ten tenths: every bin is len(y) of them
        want |= {(*k, b): round(sum(tenths[b * len(y) : (b + 1) * len(y)]) / len(y), 6) for b in range(10)}
    assert got == want


def test_bed12_exons_of_every_row(spark, tmp_path):
    rows = [
        (1, 100, "10,20,", "0,50,", "100-110,150-170"), (2, 100, "10;20", '"0" "50"', "100-110,150-170"), (3, 100, "'20'|'10'", "50 : 0", "100-110,150-170"), (4, 100, "7", "0", "100-107"),
        (5, 100, "10,nil,", "0,50,", None), (6, 100, "10,20", "0", None), (7, 100, None, "0,", None), (8, 100, "", "", None), (9, 100, "10,,5", "0,,20", None), (10, None, "10,", "0,", None), (11, 100, "9" * 30, "0", None), (12, 100, "9223372036854775807", "0", None),
    ]
    spark.createDataFrame([r[:4] for r in rows], "bed_id long, start long, blockSizes string, blockStarts string").write.parquet(f"{tmp_path}/bed12.parquet")
    got = sorted((r.bed_id, r.exons) for r in entry.queries()["bed12_exons"](spark, str(tmp_path)).collect())
    assert got == [(r[0], r[4]) for r in rows]


def test_bed12_file_keeps_every_text(spark, tmp_path):
    rows = [
        (1, "c", 1, 9, "0", "+", 1, 9, 0, 2, "5\t6", None), (2, "c", 1, 9, None, None, None, None, None, None, None, "5\r\n6\n"), (3, None, -1, None, "a\tb", "", 1, 9, 0, 1, "%09%", "\\t%4Eone"),
        (None, "None", 1, 9, "None", "-", 1, 9, 0, 1, "", "%25"), (5, "%4Eone", 1, 9, "\r", "\n", 1, 9, 0, 1, None, None), (6, "", 1, 9, "", "+", 1, 9, 0, 1, "5", "0"),
        (7, "c", 1, 9, "0", "+", 1, 9, 0, 1, "5\t6", "0"), (8, "c", 1, 9, "0", "+", 1, 9, 0, 1, "5", "0\n"),
    ]
    columns = "bed_id long, chrom string, start long, end long, score string, strand string, thickStart long, thickEnd long, itemRgb int, blockCount int, blockSizes string, blockStarts string"
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/bed12.parquet")
    got = [tuple(r[c] for c in ("name", "chrom", "start", "end", "score", "strand", "thickStart", "thickEnd", "itemRgb", "blockCount", "blockSizes", "blockStarts")) for r in entry.queries()["bed12_file"](spark, str(tmp_path)).collect()]
    texts = {4, 5, 10, 11}  # score, strand and the two lists: the SQL has None for null
    want = [tuple(str(v) if i in texts or (i == 0 and v is not None) else v for i, v in enumerate(r)) for r in rows[:6]]  # of the last two both lists are there, and one holds a tab or line end
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_flow_concat_of_whole_tables(spark, tmp_path):
    rows = [(i, i % 5, "view", 1.0) for i in range(3, 1200)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in entry.queries()["flow_concat"](spark, str(tmp_path)).collect())
    assert got == [(i, i % 5) for i in range(3, 1200)] + [(i - 3 + 1200, i % 5) for i in range(3, 1200)]
