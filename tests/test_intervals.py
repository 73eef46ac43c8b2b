"""Interval operators against the fixtures and per-base brute force."""

import random

import pytest
from pyspark.sql import functions as F

from spanweave.operators import intervals as I

ROWS = [("A", 0, 10, "+"), ("A", 10, 20, "+"), ("A", 15, 15, "+"), ("A", 30, 40, "-"), ("A", 35, 50, "+"), ("B", 5, 8, "+")]
SCHEMA = "chrom string, start long, end long, strand string"


@pytest.fixture(scope="module")
def make(spark):
    return lambda rows, schema=SCHEMA: spark.createDataFrame(rows, schema)


def spans(df, *cols):
    return sorted(tuple(r[c] for c in (cols or ("chrom", "start", "end"))) for r in df.collect())


def test_fixture_algebra(make):
    df = make(ROWS)
    assert spans(I.merge(df, ["chrom"])) == [("A", 0, 20), ("A", 30, 50), ("B", 5, 8)]
    assert spans(I.merge(df, ["chrom", "strand"]), "chrom", "strand", "start", "end") == [("A", "+", 0, 20), ("A", "+", 35, 50), ("A", "-", 30, 40), ("B", "+", 5, 8)]
    other = make([("A", 12, 33, "+")])
    assert spans(I.subtract(df, other, ["chrom"])) == [("A", 0, 12), ("A", 33, 50), ("B", 5, 8)]
    assert spans(I.intersect(df, other, ["chrom"])) == [("A", 12, 20), ("A", 30, 33)]
    assert spans(I.intersect(df, other, ["chrom"], "keep")) == [("A", 12, 20), ("A", 30, 33), ("B", 5, 8)]
    assert spans(I.depth(df, ["chrom"]), "chrom", "start", "end", "depth") == [("A", 0, 20, 1), ("A", 30, 35, 1), ("A", 35, 40, 2), ("A", 40, 50, 1), ("B", 5, 8, 1)]
    assert spans(I.depth(df, ["chrom"], True), "start", "end")[0] == (0, 19)
    hits = I.overlap_join(make([("A", 14, 16, "+")]), df, ["chrom"])
    assert sorted((r.start_b, r.end_b) for r in hits.collect()) == [(10, 20), (15, 15)]
    sizes = make([("A", 60), ("B", 5), ("C", 9)], "chrom string, length long")
    assert spans(I.complement(df, sizes, ["chrom"])) == [("A", 20, 30), ("A", 50, 60), ("B", 0, 5), ("C", 0, 9)]


def test_published_neighbours(make):
    f = make([("c", 0, 10), ("c", 3, 7), ("c", 3, 40), ("c", 13, 50)], "chrom string, start long, end long")
    assert sorted((r.start_b, r.end_b) for r in I.overlap_join(make([("c", 30, 50, "+")]), f, ["chrom"]).collect()) == [(3, 40), (13, 50)]

    def near(s, e, strand, n=1):
        q = make([("c", s, e, strand)])
        return [(r.start_b, r.end_b) for r in I.nearest_interval(q, f, ["chrom"], "before", ["end", "start"], n, stranded=strand is not None).orderBy("_rank").collect()]

    assert near(10, 20, None) == [(3, 7)]
    assert near(5, 20, None) == []
    assert near(11, 12, "+") == [(0, 10)]
    assert near(11, 12, "-") == [(13, 50)]
    assert sorted(near(1, 2, "-", 3)) == [(3, 7), (3, 40), (13, 50)]


def test_published_clusters(make):
    df = make([("c", 6, 7, 1), ("c", 1, 2, 3), ("c", 9, 10, 2), ("c", 3, 4, 0), ("c", 3, 8, 4)], "chrom string, start long, end long, id long")
    got = sorted((r.start, r.end, r.ids) for r in I.cluster(df, ["chrom"]).collect())
    assert got == [(1, 2, [3]), (3, 8, [0, 1, 4]), (9, 10, [2])]
    assert [(r.start, r.end, r.n) for r in I.cluster(df, ["chrom"], 1, 4).collect()] == [(1, 10, 5)]


def covered(rows, c):
    return {x for k, s, e, _ in rows if k == c and s is not None and e is not None for x in range(s, e)}


@pytest.mark.parametrize("seed", range(2))
def test_brute_force(make, seed, monkeypatch):
    monkeypatch.setattr(I, "TILE_BITS", 4)
    monkeypatch.setattr(I, "SHIFTS", (2, 3, 5, 62))
    rng = random.Random(seed)

    def rows(n):
        out = []
        for _ in range(n):
            s = rng.randint(-40, 90)
            out.append((rng.choice(["a", "hot", "hot", None]), None if rng.random() < 0.05 else s, s + rng.choice([0, 1, 2, 5, 40, 200]), "+"))
        return out

    a, b = rows(60), rows(40)
    da, db = make(a), make(b)
    keys = {r[0] for r in a + b if r[0]}
    want = {"intersect": lambda x, y: x & y, "subtract": lambda x, y: x - y, "symmetric": lambda x, y: x ^ y}
    for name, f in want.items():
        got = getattr(I, name)(da, db, ["chrom"]).collect()
        for c in keys:
            mine = sorted((r.start, r.end) for r in got if r.chrom == c)
            assert {x for s, e in mine for x in range(s, e)} == f(covered(a, c), covered(b, c))
            assert all(e < s2 for (_, e), (s2, _) in zip(mine, mine[1:]))
    wa, wb = da.withColumn("i", F.monotonically_increasing_id()), db.withColumn("i", F.monotonically_increasing_id())
    pairs = sorted((r.chrom, r.start, r.end, r.start_b, r.end_b) for r in I.overlap_join(wa, wb, ["chrom"]).collect())
    assert pairs == sorted((c, s, e, s2, e2) for c, s, e, _ in a for c2, s2, e2, _ in b if c and c == c2 and s is not None and s2 is not None and e > s2 and s < e2)
    left = I.overlap_join(wa, wb, ["chrom"], "left")
    assert left.select("i").distinct().count() == len(a)


def test_blocks_of_mates(make):
    cases = [
        ([(0, 10)], [(20, 30)], False, [(0, 10), (20, 30)]), ([(0, 10), (20, 30)], [(25, 40)], False, [(0, 10), (20, 40)]),
        ([(0, 10), (20, 30)], [(5, 25)], True, [(0, 10), (20, 30)]), ([(0, 10), (20, 30)], [(5, 10), (22, 30)], True, None), ([(0, 10), (20, 30)], [(5, 10), (20, 35), (50, 60)], False, [(0, 10), (20, 35), (50, 60)]),
    ]
    kind = "array<struct<start:long,end:long>>"
    df = make([(i, a, b) for i, (a, b, _, _) in enumerate(cases)], f"i int, a {kind}, b {kind}")
    for r in df.select("i", I.junctions_conflict(F.col("a"), F.col("b")).alias("c"), I.merge_blocks(F.col("a"), F.col("b")).alias("m")).collect():
        assert (r.c, r.m and [tuple(x) for x in r.m]) == cases[r.i][2:]


def test_empty(make):
    none = make([])
    assert I.merge(none, ["chrom"]).count() == I.overlap_join(none, none, ["chrom"]).count() == I.cluster(none.withColumn("id", F.lit(1)), ["chrom"]).count() == 0
