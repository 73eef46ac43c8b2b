"""Ordered-stream operators: the published examples, and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from spanweave.operators import flow

CASE1, CASE2 = [1, 2, 3, 4, 5], [1, 2, 2, 3, 4, 5, 1]


@pytest.fixture(scope="module")
def seq(spark):
    return lambda values, kind="long": spark.createDataFrame(list(enumerate(values)), f"_pos long, v {kind}").repartition(3)


def vs(df, order="_pos"):
    return [r.v for r in df.orderBy(order).collect()]


def test_examples(seq):
    one, two = seq(CASE1), seq(CASE2)
    assert vs(flow.head(one, "_pos", 1)) == [1]
    assert vs(flow.tail(one, "_pos", 2)) == [4, 5]
    assert vs(flow.skip(one, "_pos", 2)) == [3, 4, 5]
    assert vs(flow.skip(one, "_pos", 9)) == []
    assert vs(flow.keep(one, F.col("v") % 2 == 0)) == [2, 4]
    assert vs(flow.dedup(two, ["v"], "_pos")) == [1, 2, 3, 4, 5]
    assert vs(flow.uniq(two, ["v"], "_pos")) == [1, 2, 3, 4, 5, 1]
    assert flow.count(two).first()[0] == 7
    assert flow.join_text(seq([1, 2, 3]), "v", "_pos", "|").first()[0] == "1|2|3"
    got = {r.v0 + r.v1 for r in flow.permutations(seq("ABCD", "string"), "v", "_pos").collect()}
    assert got == {a + b for a in "ABCD" for b in "ABCD" if a != b}
    assert vs(flow.mapwith(one, v=F.col("v") * 2)) == [2, 4, 6, 8, 10]
    nested = seq([[[1, 2], [3, 4]], [[5], [6]]], "array<array<long>>")
    assert [r.v for r in flow.flatten(nested, "v", 2, "_pos").orderBy("_pos").collect()] == [1, 2, 3, 4, 5, 6]
    assert vs(flow.uniq(seq([1, 1, 2, 3, 3, 4, 4, 5, 4, 4]), ["v"], "_pos")) == [1, 2, 3, 4, 5, 4]


def test_whiles(seq):
    df = seq([1, 2, None, 1, 5])
    low = F.col("v") < 3
    assert vs(flow.take_while(df, low, "_pos")) == [1, 2]
    assert vs(flow.drop_while(df, low, "_pos")) == [None, 1, 5]
    assert vs(flow.skip_while(df, low)) == [None, 5]
    assert vs(flow.take_while(seq([1, 2]), low, "_pos")) == [1, 2]
    assert vs(flow.drop_while(seq([1, 2]), low, "_pos")) == []


def test_groupby2(seq):
    data = [1, 1, 2, 2, 3, 3, 4, 5, 4, 6, 7, 8]
    near = lambda x, y: y - x < 2
    got = [r["values"] for r in flow.groupby2_end(seq(data), near, "v", "_pos").orderBy("run").collect()]
    assert got == [[1, 1, 2, 2, 3, 3, 4, 5, 4], [6, 7, 8]]
    got = [r["values"] for r in flow.groupby2_start(seq(data).withColumn("k", F.lit(1)), near, "v", "_pos", ["k"]).orderBy("group").collect()]
    assert got == [[1, 1, 2, 2], [3, 3, 4], [5, 4, 6], [7, 8]]


def test_runs_keep_nulls(seq):
    got = [(r.run, r["values"]) for r in flow.kgroupby(seq([None, None, 1, None, 1, 1]).withColumn("w", F.col("_pos")), ["v"], "w", "_pos").orderBy("run").collect()]
    assert got == [(0, [0, 1]), (2, [2]), (3, [3]), (4, [4, 5])]


def windows(values, w, s):
    """The rule of count windows, spelt out."""
    out, at = [], 0
    while at + w <= len(values):
        out.append(values[at : at + w])
        at += s
    seen = (len(out) - 1) * s + w if out else 0
    if seen < len(values) and values[at:]:
        out.append(values[at:])
    return out


@pytest.mark.parametrize(("n", "w", "s"), [(7, 3, 2), (8, 3, 2), (9, 2, 3), (10, 2, 5), (2, 5, 1), (0, 2, 1), (6, 2, 2), (7, 3, 1)])
def test_window(seq, n, w, s):
    got = [r["values"] for r in flow.window(seq(range(n)), "v", "_pos", w, s).orderBy("start").collect()]
    assert got == windows(list(range(n)), w, s)


def test_slices_and_context(seq):
    df = seq([x * x for x in range(20)])
    assert vs(flow.islice(df, "_pos", 3, 15, 4)) == [9, 49, 121]
    assert vs(flow.around(df, F.col("v").isin(0, 4), "_pos", 1, 1), ["match", "_pos"]) == [0, 1, 1, 4, 9]
    assert vs(flow.concat(seq([1, 2]), seq([3, 4]), "_pos")) == [1, 2, 3, 4]
    got = [r["values"] for r in flow.transpose(seq([[1, 2, 3], [4, 5]], "array<long>"), "v", "_pos").orderBy("pos").collect()]
    assert got == [[1, 4], [2, 5]]
    assert vs(flow.sort(df.withColumn("k", F.col("v") % 3), ["k"], "_pos", True), [F.col("k").desc(), "_pos"])[:3] == [1, 4, 16]


def test_empty(seq):
    none = seq([])
    for df in (flow.head(none, "_pos"), flow.uniq(none, ["v"], "_pos"), flow.dedup(none, ["v"], "_pos"), flow.kgroupby(none, ["v"], "_pos", "_pos"), flow.numbered(none, "_pos"), flow.transpose(none.select("_pos", F.array("v").alias("v")), "v", "_pos")):
        assert df.count() == 0


def test_long_runs_cross_blocks(seq):
    rng = random.Random(1)
    data = [x for _ in range(60) for x in [rng.randint(0, 1)] * rng.randint(1, 9)]
    want, at = [], 0
    for i in range(1, len(data) + 1):
        if i == len(data) or data[i] != data[at]:
            want.append((at, i - at))
            at = i
    got = [(r.run, len(r["values"])) for r in flow.kgroupby(seq(data), ["v"], "_pos", "_pos").orderBy("run").collect()]
    assert got == want
