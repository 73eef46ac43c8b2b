"""Joins with hot keys, and intervals at any scale on one key, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from spanweave import runtime
from spanweave.functions.attributes import attribute_map, with_attributes
from spanweave.operators import intervals as iv
from spanweave.operators import wide


def test_hot_join(spark, monkeypatch):
    monkeypatch.setattr(runtime, "HOT_SHARE", 4)
    big = spark.createDataFrame([(i, "a" if i % 3 else f"k{i}") for i in range(90)] + [(99, None)], "i long, k string")
    small = spark.createDataFrame([("a", 1), ("k3", 2), ("z", 3)], "k string, v long")
    counted = big.groupBy("k").agg(F.count("*").alias("n"))
    hot = runtime.hot_keys(counted, ["k"], "n", big)
    assert [r.k for r in hot.collect()] == ["a"]
    want = sorted(tuple(r) for r in big.join(small, "k").collect())
    assert sorted(tuple(r) for r in runtime.hot_join(big, small, ["k"], hot).collect()) == want
    assert runtime.hot_join(big.limit(0), small, ["k"], hot).count() == 0


def rows(rng, n, reach, width):
    out = []
    for i in range(n):
        s = rng.randrange(reach)
        out.append((i, "one", s, s + rng.choice([0, 1, 5, rng.randrange(width)])))
    return out


@pytest.mark.parametrize("reach,width", [(40, 10), (10**5, 3000), (10**8, 10**7), (2**50, 2**45)])
def test_overlaps_on_one_key(spark, reach, width):
    rng = random.Random(reach)
    a, b = rows(rng, 120, reach, width), rows(rng, 80, reach, width)
    frames = [spark.createDataFrame(x + [(999, None, 1, 2), (998, "one", None, 2)], "id long, chrom string, start long, end long") for x in (a, b)]
    got = sorted((r.id, r.id_b) for r in iv.overlap_join(*frames, ["chrom"]).collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[3] > y[2] and x[2] < y[3])
    assert iv.overlap_join(frames[0], frames[1].limit(0), ["chrom"]).count() == 0
    assert iv.overlap_join(frames[0].limit(0), frames[1], ["chrom"]).count() == 0


def test_keys_of_the_join_are_small(spark):
    """No key holds more than 2 % of the rows, though all lie on one chromosome and some intervals span it."""
    rng = random.Random(3)
    df = spark.createDataFrame(rows(rng, 4000, 2**24, 3000) + [(5000, "one", 0, 2**24)], "id long, chrom string, start long, end long")
    width, level = F.lit(2**24), F.lit(3)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64("id"), iv._salts(width, level)).cast("int")).withColumn("_bin", iv._bin(F.col("start"), level))
    assert salted.groupBy("_bin", "_salt").count().agg(F.max("count")).first()[0] < 0.03 * 4001
    assert df.transform(lambda x: iv.overlap_join(x, x, ["chrom"], ident="id")).where("id = 5000 OR id_b = 5000").count() >= 2 * 3000


@pytest.mark.parametrize("bits", [3, 20])
def test_stretches_in_one_sweep(spark, bits, monkeypatch):
    monkeypatch.setattr(iv, "TILE_BITS", bits)
    rng = random.Random(bits)
    a, b = rows(rng, 40, 300, 30), rows(rng, 30, 300, 40)
    fa, fb = (spark.createDataFrame(x, "id long, chrom string, start long, end long") for x in (a, b))
    over = [{p for x in side for p in range(x[2], x[3])} for side in (a, b)]

    def spans(points):
        out = []
        for p in sorted(points):
            if out and out[-1][1] == p:
                out[-1] = (out[-1][0], p + 1)
            else:
                out.append((p, p + 1))
        return out

    for got, want in ((iv.merge(fa, ["chrom"]), over[0]), (iv.intersect(fa, fb, ["chrom"]), over[0] & over[1]), (iv.subtract(fa, fb, ["chrom"]), over[0] - over[1]), (iv.symmetric(fa, fb, ["chrom"]), over[0] ^ over[1])):
        assert sorted((r.start, r.end) for r in got.collect()) == spans(want)


def test_one_parser(spark):
    texts = ['gene_id "a; b" ; Gene=\'it\'s\'; tag x; tag "y"; level .; gene_biotype ""', None, "", ";;", "k\u00a0v"]
    df = spark.createDataFrame(list(enumerate(texts)), "record_id long, attributes string")
    got = [tuple(r)[2:] for r in with_attributes(df, ["gene_id", "gene_name", "tag", "level", "gene_type", "k"]).orderBy("record_id").collect()]
    assert got == [("a; b", "it's", "x", None, None, None), (None,) * 6, (None,) * 6, (None,) * 6, (None, None, None, None, None, "v")]
    maps = [r[0] for r in df.orderBy("record_id").select(attribute_map(F.col("attributes"))).collect()]
    assert maps == [{"gene_id": "a; b", "Gene": "it's", "tag": "x,y", "level": ".", "gene_biotype": ""}, None, {}, {}, {"k": "v"}]
    assert wide.gtf_wide(df).where("tag = 'x,y' AND gene_name = 'it''s'").count() == 1
