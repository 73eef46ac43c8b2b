"""Problems 1 to 5 on small tables: nulls, empty and long values, ties, repeats, empty tables, clashing names."""

import random
import re

import pytest
from pyspark.sql import functions as F

from spanweave.operators import badrows, coverage, hotkeys, packed, wide

GOOD = 'gene_id "G1"; tag "a; b"; level 2;'


def gtf_line(attributes=GOOD, score="."):
    return "\t".join(["c", "s", "exon", "1", "2", score, "+", ".", attributes])


def bed_line(score="0"):
    return "\t".join(["c", "1", "2", "n", score, "+", "1", "2", "0", "1", "1,", "0,"])


CASES = [
    (gtf_line(), None), (gtf_line() + "\r", None), (gtf_line() + "\r\r", None), ("# " + gtf_line(), "skip"), ("", "skip"), ("\r", "skip"), (None, "skip"),
    (gtf_line().replace("\t", " "), "column_count"), (gtf_line() + "\tx", "column_count"), ("\t" * 30_000, "column_count"),
    (gtf_line('gene_id "G1; tag "b";'), "quoting"), (gtf_line('gene_id "G1; tag "b; x 1'), "quoting"), (gtf_line('gene_id ""G1"";'), "quoting"), (gtf_line('gene_id" G1;'), "quoting"),
    (gtf_line('gene_id "G1";; tag "b";'), "value"), (gtf_line('; gene_id "G1"'), "value"), (gtf_line(""), "value"), (gtf_line("."), "value"), (gtf_line("gene_id two words;"), "value"), (gtf_line("tag;"), "value"),
    (gtf_line('a ""; b c ;  '), None), (gtf_line(' a "x y" ;b "" '), None), (gtf_line("a \x01"), None), (gtf_line("; ".join(f'k{i} "v"' for i in range(20_000))), None),
    *[(gtf_line(score=s), None) for s in ("1", "+4", "-3.25", "1e-9", "2.5E+3", "007")], *[(gtf_line(score=s), "value") for s in ("", "nan", "1e", "5.", ".5", "1,2", " 1", "#")],
]


def test_bad_rows(spark):
    rows = [(i, "gtf", x, "clash") for i, (x, _) in enumerate(CASES)]
    bed = [("0", None), ("1000", None), ("0001000", None), ("1001", "value"), ("", "value"), ("-1", "value"), ("99999999999999999999", "value"), ("1.0", "value")]
    rows += [(1000 + i, "bed12", bed_line(s), "clash") for i, (s, _) in enumerate(bed)] + [(2000, None, "x", ""), (2001, "other", "x", "")]
    raw = spark.createDataFrame(rows, "line_id long, kind string, line string, _text string")
    want = {i: r for i, (_, r) in enumerate(CASES) if r not in (None, "skip")} | {1000 + i: r for i, (_, r) in enumerate(bed) if r}
    assert {r.line_id: r.reason for r in badrows.failing_lines(raw).collect()} == want
    sound = {r.line_id: r for r in badrows.sound_records(raw, "gtf").collect()}
    assert set(sound) == {i for i, (_, r) in enumerate(CASES) if r is None}
    assert sound[0].attributes == GOOD and sound[0].start == 1
    kept = badrows.parse_lines(raw.withColumn("reason", F.lit("old")).withColumn("_read", F.lit(1)), "gtf")
    assert kept.columns == ["line_id", "kind", "line", "_text", "_read", "reason", "record"]
    assert badrows.failing_lines(raw.limit(0)).count() == 0


def pieces_by_rule(field):
    text = re.sub(r"""["']""", "", field)
    text = re.sub(r"\s+", " ", text).strip(" ")
    text = re.sub(r" ?([,;:|/，]) ?", ",", text).replace(" ", ",")
    out = text.split(",")
    return out[:-1] if out and out[-1] == "" else out


def test_pieces_match_rule():
    cut, rng = packed.segmenter(packed.block_values()), random.Random(4)
    parts = ["12", "0", "00123", "98765", "nil", "NA", "-", "x9", ",", ";", " ", "  ", "\xa0", " | ", "/", ":", "，", '"', "'", "\t", ","]
    for _ in range(4000):
        field = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert cut(field) == pieces_by_rule(field), field


def test_known_values_protect_delimiters():
    cut = packed.segmenter(["Smith, John", "a/b", "x"])
    assert cut('"Smith, John", x; a/b; c/d') == ["Smith, John", "x", "a/b", "c", "d"]
    assert cut("Smith, Johnny") == ["Smith", "Johnny"]


def test_block_list(spark):
    df = spark.createDataFrame([(1, '"12|nil"| 007,', "0,"), (1, '"12|nil"| 007,', None), (2, "", "  "), (3, None, ",5,,6"), (4, "9" * 30, "1 " * 50_000)], "bed_id long, blockSizes string, blockStarts string").withColumn("val", F.lit(1))
    got = sorted(tuple(r) for r in packed.block_list(df).where("bed_id < 4").collect())
    assert got == [(1, "blockSizes", 0, 12), (1, "blockSizes", 0, 12), (1, "blockSizes", 2, 7), (1, "blockSizes", 2, 7), (1, "blockStarts", 0, 0), (3, "blockStarts", 1, 5), (3, "blockStarts", 3, 6)]
    assert packed.block_list(df).where("bed_id = 4").count() == 50_000
    assert packed.block_list(df.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [100_000, 3])
def test_hot_keys(spark, limit, monkeypatch):
    monkeypatch.setattr(hotkeys, "LOCAL_KEYS", 50)
    rng = random.Random(1)
    keys = ["hot"] * 900 + [f"k{i}" for i in range(1500)] + ["", None] * 5
    rows = [(k, rng.choice([None, rng.randint(-50, 50)]), rng.randint(0, 9), rng.choice([None, "a", "b", "c"]), 0) for k in keys for _ in range(2)]
    df = spark.createDataFrame(rows, "k string, lo long, hi int, m string, n_rows int").repartition(7)
    got = {r.k: (r.n_rows, r.min_low, r.max_high) for r in hotkeys.key_profile(df, "k", "lo", "hi", limit).collect()}
    want = {}
    for k, lo, hi, *_ in rows:
        if k is not None:
            n, a, b = want.get(k, (0, None, None))
            want[k] = n + 1, lo if a is None else a if lo is None else min(a, lo), hi if b is None else max(b, hi)
    assert got == want
    distinct = {r.k: r.n_distinct for r in hotkeys.distinct_per_key(df, "k", "m", limit).collect()}
    members = {}
    for k, _, _, m, _ in rows:
        if k is not None and m is not None:
            members.setdefault(k, set()).add(m)
    assert distinct == {k: len(v) for k, v in members.items()}
    assert [r.key_value for r in hotkeys.heavy_keys(df, "k", "t.k").collect()] == ["hot"]
    assert hotkeys.key_profile(df.limit(0), "k", broadcast_keys=limit).count() == 0


def test_attribute_styles(spark):
    texts = {
        1: 'gene_id "G1"; tag "a"; TAG "b"; exon_number 02; level "x"; note "s; tag \'z\'";', 2: "gene='Abe' 5' x'; gene_biotype=lnc;level=+3; support=-0", 3: "gene_name '.'; transcript_id '' ;tag . ; gene_id \" G 2 \"",
        4: None, 5: "", 6: ".", 7: 'gene_id "G1"; gene_id "G1"; level 99999999999999999999; exon_number 1/2',
    }
    df = spark.createDataFrame(list(texts.items()), "record_id long, attributes string").withColumn("tag", F.lit("clash"))
    got = {r.record_id: {k: v for k, v in r.asDict().items() if v is not None and k != "record_id"} for r in wide.gtf_wide(df).collect()}
    assert got == {
        1: {"gene_id": "G1", "tag": "a,b", "exon_number": 2}, 2: {"gene_name": "Abe' 5' x", "gene_type": "lnc", "level": 3, "support": 0}, 3: {"gene_id": "G 2"}, 4: {}, 5: {}, 6: {}, 7: {"gene_id": "G1"},
    }
    cells = wide.cells(wide.gtf_wide(df), "record_id", list(wide.GTF_COLUMNS)).where("record_id = 1").collect()
    assert sorted((r.col_name, r.cell) for r in cells) == [("exon_number", "2"), ("gene_id", "G1"), ("tag", "a,b")]
    assert wide.gtf_wide(df.limit(0)).count() == 0


def test_wide_from_scattered_rows(spark):
    rng = random.Random(2)
    rows = [("big" if rng.random() < 0.4 else f"e{rng.randint(0, 40)}", rng.choice(["a", "b", "n", "list", "other", None]), i, rng.choice([None, "x", "y", "7", "-3"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "ent string, att string, ord long, val string").repartition(6)
    got = {r.ent: (r.a, r.b, r.n, r.list) for r in wide.to_wide(df, "ent", "att", "ord", "val", {"a": "string", "b": "string", "n": "bigint", "list": "string"}, ("list",)).collect()}
    want = {}
    for e in {r[0] for r in rows}:
        mine = [(a, v) for x, a, _, v in rows if x == e and v is not None]
        first = lambda c, ok=lambda v: True: next((v for a, v in mine if a == c and ok(v)), None)  # noqa: E731, B023
        n = first("n", lambda v: v.lstrip("-").isdigit())
        want[e] = first("a"), first("b"), None if n is None else int(n), ",".join(v for a, v in mine if a == "list") or None
    assert got == {e: w for e, w in want.items() if any(x is not None for x in w)}


def test_interval_map():
    rng = random.Random(3)
    for _ in range(300):
        m, covered = coverage.IntervalMap(), set()
        for _ in range(rng.randint(0, 25)):
            s = rng.randint(-20, 60)
            e = s + rng.randint(-2, 8)
            m.add(s, e)
            covered |= set(range(s, e))
        runs, at = [], None
        for x in sorted(covered):
            if at is None or x != at + 1:
                runs.append([x, x + 1])
            runs[-1][1] = at = x
            runs[-1][1] += 1
        assert list(zip(m.starts, m.ends)) == [tuple(r) for r in runs]


@pytest.mark.parametrize("tile", [4, 1 << 18])
def test_stretches(spark, tile, monkeypatch):
    monkeypatch.setattr(coverage, "TILE", tile)
    monkeypatch.setattr(coverage, "HELD", 40)
    rng = random.Random(tile)
    rows = []
    for _ in range(500):
        s = rng.choice([None, rng.randint(-60, 200)])
        rows.append((rng.choice(["a", "b", "hot", "hot", None]), s, None if s is None else s + rng.choice([0, -1, 1, 2, 3, 30]), rng.choice([1, 2]), "x"))
    df = spark.createDataFrame(rows, "tile string, start long, end long, s int, e string").repartition(5)
    got = sorted(tuple(r) for r in coverage.stretches(df, ["tile", "s"]).collect())
    want = []
    for k in {(r[0], r[3]) for r in rows if r[0] is not None}:
        m = coverage.IntervalMap()
        for r in rows:
            if (r[0], r[3]) == k and r[1] is not None:
                m.add(r[1], r[2])
        want += [("merged", *k, s, e) for s, e in zip(m.starts, m.ends)] + [("gap", *k, s, e) for s, e in m.gaps()]
    assert got == sorted(want)
    assert coverage.stretches(df.limit(0), ["tile"]).count() == 0


def test_filled_place_holders(spark):
    df = spark.createDataFrame([(1, 0, "-00,5,+07,-3,0nil,-", "00NA;-0;000;-01")], "bed_id long, start long, blockSizes string, blockStarts string")
    got = sorted((r.field_name, r.pos, r.val) for r in packed.block_list(df).collect())
    assert got == [("blockSizes", 1, 5), ("blockSizes", 2, 7), ("blockSizes", 3, -3), ("blockStarts", 2, 0), ("blockStarts", 3, -1)]


def test_typed_scores(spark):
    head = "c\ts\texon\t1\t2\t"
    lines = [head + s + '\t.\t.\tgene_id "g";' for s in (".", "-1.5e3", "NaN", "1d", "", "1.", "7")] + [head + "1\t+\t.", head + "1\t+\t.\tk v\tx"]
    df = spark.createDataFrame([(i, "gtf", x) for i, x in enumerate(lines)], "line_id long, kind string, line string")
    assert {r.line_id: r.reason for r in badrows.failing_lines(df).collect()} == {2: "value", 3: "value", 4: "value", 5: "value", 7: "column_count", 8: "column_count"}
    assert sorted((r.line_id, r.score, r.strand, r.frame) for r in badrows.sound_records(df, "gtf").where("score IS NOT NULL").collect()) == [(1, -1500.0, ".", "."), (6, 7.0, ".", ".")]
    bed = ["c\t1\t2\tn\t" + s + "\t+\t1\t2\t.\t1\t1,\t0," for s in ("0", "1000", "1001", "+5", "007", ".", "99999999999")]
    df = spark.createDataFrame([(i, "bed12", x) for i, x in enumerate(bed)], "line_id long, kind string, line string")
    assert {r.line_id for r in badrows.failing_lines(df).collect()} == {2, 3, 5, 6}
    assert sorted((r.score, r.itemRgb) for r in badrows.sound_records(df, "bed12").collect()) == [(0, "."), (7, "."), (1000, ".")]
