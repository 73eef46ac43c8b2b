"""Interval joins and interval algebra (J1-J9, P4-P6, I1-I10, W7). Intervals are 0-based and half-open.

Overlap joins bin both sides: a pair meets at the level of bins that fits its wider interval, so that no interval has more than two bins at a level, and rows go only to levels that the
other side has. Where the bins of a level are few, the narrower side is spread over salts and the wider one repeated, so that no key of the join holds much more than one row in ``SPREAD`` of a
key's. A pair is kept in the bin of the later start only, so nothing is made distinct. Sweeps cut the line of each key into tiles: events are summed by position before they move, and tiles
meet through one short row each, so that a key with most rows is still many tasks.

Defined results: rows with a null key or bound overlap nothing and cover nothing; reversed and empty intervals cover nothing, though an empty interval strictly
inside another one overlaps it; touching runs join; repeats count as often as they stand in joins and depth.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanweave.runtime import attach, once

#: log2 of the bins' width, level by level; for intervals of any 64-bit width.
SHIFTS = tuple(range(14, 63, 4))
#: A level's bins and salts together are this many at the least, over the extent of the build side.
SPREAD = 64
TILE_BITS = 20


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Strict overlap of half-open intervals."""
    return (a_end > b_start) & (a_start < b_end)


def any_overlap(a: Column, b: Column) -> Column:
    """P5: do two arrays of (start, end) structs hold a pair that overlaps."""
    return F.exists(a, lambda x: F.exists(b, lambda y: overlaps(x["start"], x["end"], y["start"], y["end"])))


def is_match(a: tuple[Column, ...], b: tuple[Column, ...], shift: int = 2) -> Column:
    """(chrom, start, end, strand) of two intervals agree, both ends within ``shift``."""
    return (a[0] == b[0]) & a[3].eqNullSafe(b[3]) & (F.abs(a[1] - b[1]) <= shift) & (F.abs(a[2] - b[2]) <= shift)


def _bin(x: Column, level: Column) -> Column:
    return F.call_function("shiftright", x, F.get(F.array(*map(F.lit, SHIFTS)), level))


def _level(start: Column, end: Column) -> Column:
    out = F.lit(len(SHIFTS) - 1)
    for k in range(len(SHIFTS) - 2, -1, -1):
        out = F.when(end - start <= 1 << SHIFTS[k], k).otherwise(out)
    return out


def _salts(width: Column, level: Column) -> Column:
    """How many salts a bin of ``level`` is spread over, where the build side is ``width`` wide."""
    return F.greatest(F.floor(F.lit(SPREAD) / (_bin(width, level) + 1)), F.lit(1)).cast("int")


def _hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if not isinstance(f.dataType, T.MapType | T.VariantType)]


def _levels(own: str) -> Column:
    return F.coalesce(F.collect_set(own), F.array().cast("array<int>")).alias("levels")


def _placed(df: DataFrame, keys: list[str], start: str, end: str, side: str) -> DataFrame:
    """Rows that can overlap anything, with the level that fits them."""
    ok = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in [*keys, start, end]])
    return df.where(ok & (F.col(end) >= F.col(start))).withColumn("_own" + side, _level(F.col(start), F.col(end)))


def _spread(df: DataFrame, start: str, end: str, width: Column, salted: Column, row: list[str], side: str) -> DataFrame:
    """Bins and salts of the level ``_at``: one salt of a row that is ``salted``, all salts of any other."""
    df = df.select("*", F.col("_at.kind").alias("_kind" + side), F.col("_at.level").alias("_level" + side))
    level = F.col("_level" + side)
    df = df.withColumn("_bin" + side, F.explode(F.sequence(_bin(F.col(start), level), _bin(F.greatest(F.col(end) - 1, F.col(start)), level))))
    salts = _salts(width, level)
    every = F.when(salted, F.array(F.pmod(F.xxhash64(*row), salts).cast("int"))).otherwise(F.sequence(F.lit(0), salts - 1))
    return df.withColumn("_salt" + side, F.explode(every)).drop("_at")


def overlap_join(probe: DataFrame, build: DataFrame, keys: list[str], how: str = "inner", start: str = "start", end: str = "end", suffix: str = "_b", ident: str | None = None) -> DataFrame:
    """Each pair of rows with equal keys and overlapping intervals; columns of ``build`` get ``suffix``. ``left`` keeps every probe row;
    it finds the rows without a partner by the unique column ``ident``, or by all columns (equal rows have equal partners)."""
    probe = once(probe)
    b = once_b = once(build).select(*[F.col(c).alias(c + suffix) for c in build.columns])
    bs, be = start + suffix, end + suffix
    b = _placed(b, [k + suffix for k in keys], bs, be, "_b")
    a = _placed(probe, keys, start, end, "_a")
    known = b.agg(F.struct(_levels("_own_b"), F.min(bs).alias("lo"), F.max(be).alias("hi")).alias("_known"))  # one row
    others = a.agg(_levels("_own_a").alias("_others"))
    width = F.col("_known.hi") - F.col("_known.lo")
    own = F.col("_own_a")
    up = F.transform(F.filter("_known.levels", lambda x: x >= own), lambda x: F.struct(F.lit(0).alias("kind"), x.alias("level")))
    host = F.when(F.coalesce(F.array_min("_known.levels") < own, F.lit(False)), F.array(F.struct(F.lit(1).alias("kind"), own.alias("level")))).otherwise(F.filter(up, lambda x: F.lit(False)))
    a = a.transform(attach, known).where((F.col(end) >= F.col("_known.lo")) & (F.col(start) <= F.col("_known.hi")))
    row = [ident] if ident else _hashable(probe)
    a = _spread(a.withColumn("_at", F.explode(F.concat(up, host))), start, end, width, F.col("_at.kind") == 0, row, "_a").drop("_known")
    own = F.col("_own_b")
    up = F.transform(F.filter("_others", lambda x: x > own), lambda x: F.struct(F.lit(1).alias("kind"), x.alias("level")))
    b = b.transform(attach, known).transform(attach, others).withColumn("_at", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("kind"), own.alias("level"))), up)))
    b = _spread(b, bs, be, width, F.col("_at.kind") == 1, _hashable(once_b), "_b").drop("_known", "_others")
    on = [F.col(k) == F.col(k + suffix) for k in keys]
    on += [F.col(f"_{c}_a") == F.col(f"_{c}_b") for c in ("kind", "level", "bin", "salt")]
    on += [overlaps(F.col(start), F.col(end), F.col(bs), F.col(be)), F.col("_bin_a") == _bin(F.greatest(F.col(start), F.col(bs)), F.col("_level_a"))]
    pairs = a.join(b, reduce(lambda x, y: x & y, on)).drop(*[f"_{c}_{x}" for c in ("own", "kind", "level", "bin", "salt") for x in "ab"])
    if how == "inner":
        return pairs
    if ident is not None:
        partners = pairs.select(F.col(ident).alias("_ident"), *[c for c in pairs.columns if c not in probe.columns])
        return probe.join(partners, F.col(ident) == F.col("_ident"), "left").drop("_ident")
    same = [f"_same{i}" for i in range(len(probe.columns))]
    met = pairs.select(*[F.col(c).alias(s) for c, s in zip(probe.columns, same)]).distinct()
    none = probe.join(met, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(s)) for c, s in zip(probe.columns, same)]), "left_anti")
    return pairs.unionByName(none, allowMissingColumns=True)


def overlap_bases(start: Column, end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.least(end, b_end) - F.greatest(start, b_start), F.lit(0))


def nearest(points: DataFrame, features: DataFrame, keys: list[str], point: str, side: str, order: list[str], n: int = 1, max_dist: int = 2500, start: str = "start", end: str = "end", suffix: str = "_b", ident: str | None = None) -> DataFrame:
    """The ``n`` features that end 1 to ``max_dist`` before ``point`` (side ``before``), or start as far after it; ``_rank`` from 1.

    ``order`` names columns of the features that break ties of distance; ``ident`` is a unique column of the points, without it rows are numbered as they are read.
    """
    f = features.select(*[F.col(c).alias(c + suffix) for c in features.columns]).withColumn("_at", F.col((end if side == "before" else start) + suffix))
    bits = max(1, (max_dist - 1).bit_length())
    p = points.withColumn("_row", F.col(ident) if ident else F.monotonically_increasing_id())
    lo, hi = (F.col(point) - max_dist, F.col(point) - 1) if side == "before" else (F.col(point) + 1, F.col(point) + max_dist)
    p = p.where(F.col(point).isNotNull()).withColumn("_bin", F.explode(F.sequence(F.shiftright(lo, bits), F.shiftright(hi, bits))))
    f = f.withColumn("_bin_b", F.shiftright("_at", bits))
    on = reduce(lambda x, y: x & y, [F.col(k) == F.col(k + suffix) for k in keys] + [F.col("_bin") == F.col("_bin_b"), F.col("_at").between(lo, hi)])
    dist = F.col(point) - F.col("_at") if side == "before" else F.col("_at") - F.col(point)
    pairs = p.join(f, on).withColumn("distance", dist)
    rank = F.row_number().over(Window.partitionBy("_row").orderBy("distance", *[c + suffix for c in order]))
    return pairs.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_row", "_bin", "_bin_b", "_at")


def nearest_interval(queries: DataFrame, features: DataFrame, keys: list[str], side: str, order: list[str], n: int = 1, max_dist: int = 2500, stranded: bool = False, ident: str | None = None) -> DataFrame:
    """Neighbours of intervals; ``stranded``: upstream (``before``) and downstream (``after``) as the strand of the query has it."""
    if not stranded:
        at = "start" if side == "before" else "end"
        return nearest(queries.withColumn("_point", F.col(at)), features, keys, "_point", side, order, n, max_dist, ident=ident).drop("_point")
    other = "after" if side == "before" else "before"
    minus = F.coalesce(F.col("strand") == "-", F.lit(False))
    return nearest_interval(queries.where(~minus), features, keys, side, order, n, max_dist, ident=ident).unionByName(nearest_interval(queries.where(minus), features, keys, other, order, n, max_dist, ident=ident))


def _points(sides: list[DataFrame], keys: list[str], start: str, end: str) -> tuple[DataFrame, list[str]]:
    """keys, pos, tile and by how much the number of intervals of each side changes at pos."""
    marks = [f"n{i}" for i in range(len(sides))]
    events = []
    for i, df in enumerate(sides):
        ok = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in [*keys, start, end]]) & (F.col(end) > F.col(start))
        one = df.where(ok).select(*keys, F.explode(F.array(F.struct(F.col(start).cast("bigint").alias("pos"), F.lit(1).alias("d")), F.struct(F.col(end).cast("bigint").alias("pos"), F.lit(-1).alias("d")))).alias("x"))
        events.append(one.select(*keys, "x.pos", *[(F.col("x.d") if j == i else F.lit(0)).cast("bigint").alias(m) for j, m in enumerate(marks)]))
    every = reduce(DataFrame.unionByName, events)
    points = every.groupBy(*keys, "pos").agg(*[F.sum(m).alias(m) for m in marks]).where(reduce(lambda x, y: x | y, [F.col(m) != 0 for m in marks]))
    return points.withColumn("tile", F.shiftright("pos", TILE_BITS)), marks


def _summed(points: DataFrame, keys: list[str], marks: list[str]) -> DataFrame:
    """``points`` with ``_n*``, the numbers of intervals right after each, and ``_next``, where the next tile begins."""
    across = Window.partitionBy(*keys).orderBy("tile")  # one row per tile
    tiles = points.groupBy(*keys, "tile").agg(F.min("pos").alias("first"), *[F.sum(m).alias(m) for m in marks])
    tiles = tiles.select(*keys, "tile", F.lead("first").over(across).alias("_next"), *[(F.sum(m).over(across) - F.col(m)).alias("_" + m) for m in marks])
    inside = Window.partitionBy(*keys, "tile").orderBy("pos")
    return points.join(tiles, [*keys, "tile"]).withColumns({"_" + m: F.col("_" + m) + F.sum(m).over(inside) for m in marks})


def sweep(sides: list[DataFrame], keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """keys, start, end, n0, n1, ...: the segments between neighbouring ends, with the number of intervals of each side over them."""
    points, marks = _points(sides, keys, start, end)
    inside = Window.partitionBy(*keys, "tile").orderBy("pos")
    end_at = F.coalesce(F.lead("pos").over(inside), F.col("_next"))
    return _summed(points, keys, marks).select(*keys, F.col("pos").alias(start), end_at.alias(end), *[F.col("_" + m).alias(m) for m in marks]).where(F.col(end).isNotNull())


def stretches(sides: list[DataFrame], keys: list[str], covered: Callable[..., Column]) -> DataFrame:
    """keys, start, end: maximal stretches over which ``covered``, a function of the numbers of intervals of each side, holds (not where all are 0).

    Only the places where it turns are kept. Turns of one tile are paired there; a stretch that reaches into later tiles is paired over the first and last turn of each tile.
    """
    points, marks = _points(sides, keys, "start", "end")
    after, before = [F.col("_" + m) for m in marks], [F.col("_" + m) - F.col(m) for m in marks]
    turns = _summed(points, keys, marks).where(covered(*after) != covered(*before)).select(*keys, "tile", "pos", covered(*after).alias("_on"))
    inside = Window.partitionBy(*keys, "tile").orderBy("pos")
    turns = turns.withColumn("end", F.lead("pos").over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    near = turns.where(F.col("_on") & F.col("end").isNotNull()).select(*keys, F.col("pos").alias("start"), "end")
    edges = turns.where(F.col("_first") | F.col("end").isNull()).withColumn("_last", F.col("end").isNull())
    far = edges.withColumn("end", F.lead("pos").over(Window.partitionBy(*keys).orderBy("pos"))).where("_on AND _last")  # two rows per tile
    return near.unionByName(far.select(*keys, F.col("pos").alias("start"), "end"))


def merge(df: DataFrame, keys: list[str]) -> DataFrame:
    """Union as disjoint runs, touching ones joined."""
    return stretches([df], keys, lambda n: n > 0)


def intersect(a: DataFrame, b: DataFrame, keys: list[str], on_missing: str = "drop") -> DataFrame:
    """Runs covered by both; with ``keep`` the keys that b lacks keep the runs of a."""
    both = stretches([a, b], keys, lambda m, n: (m > 0) & (n > 0))
    if on_missing == "drop":
        return both
    return both.unionByName(merge(a.join(b.select(*keys).distinct(), keys, "left_anti"), keys))


def subtract(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Runs covered by a and not by b."""
    return stretches([a, b], keys, lambda m, n: (m > 0) & (n == 0))


def symmetric(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """I6 xor: runs covered by exactly one side."""
    return stretches([a, b], keys, lambda m, n: (m > 0) != (n > 0))


def complement(df: DataFrame, sizes: DataFrame, keys: list[str], length: str = "length") -> DataFrame:
    """What each key's [0, length) has uncovered; keys without intervals come out whole."""
    whole = sizes.select(*keys, F.lit(0).cast("bigint").alias("start"), F.col(length).cast("bigint").alias("end"))
    return subtract(whole, df.select(*keys, "start", "end"), keys)


def depth(df: DataFrame, keys: list[str], inclusive_end: bool = False) -> DataFrame:
    """Runs of equal depth above 0; ``inclusive_end`` gives the last covered base as end."""
    out = sweep([df], keys).where("n0 > 0").withColumnRenamed("n0", "depth")
    return out.withColumn("end", F.col("end") - 1) if inclusive_end else out


def covered(df: DataFrame, keys: list[str]) -> DataFrame:
    """I6 count_range over each key: covered positions."""
    return sweep([df], keys).where("n0 > 0").groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("covered"))


def cluster(df: DataFrame, keys: list[str], max_dist: int = 0, min_size: int = 1, ident: str = "id") -> DataFrame:
    """Clusters of intervals at most ``max_dist`` apart, with at least ``min_size`` members; keys, start, end, n, ids (sorted).

    The runs of the widened intervals are the clusters; each interval then joins its run, so that no key is one task.
    """
    wide = df.withColumn("end", F.greatest(F.col("end"), F.col("start")) + max_dist + 1)  # half-open and strict: overlap means at most max_dist apart
    runs = _runs_exact(wide, keys).withColumnsRenamed({"start": "run_start", "end": "run_end"})
    runs = runs.withColumn("start", F.col("run_start")).withColumn("end", F.col("run_end"))
    got = overlap_join(df.select(*keys, "start", F.greatest(F.col("end"), F.col("start") + 1).alias("end"), F.col("end").alias("_end"), ident), runs, keys)
    out = got.groupBy(*keys, "run_start_b").agg(F.min("start").alias("start"), F.max("_end").alias("end"), F.count("*").alias("n"), F.array_sort(F.collect_list(ident)).alias("ids"))
    return out.where(F.col("n") >= min_size).drop("run_start_b")


def _runs_exact(df: DataFrame, keys: list[str]) -> DataFrame:
    """Runs where strictly overlapping intervals join and touching ones do not."""
    half = df.select(*keys, (F.col("start") * 2).alias("start"), (F.col("end") * 2 - 1).alias("end"))
    return merge(half, keys).select(*keys, F.expr("start div 2").alias("start"), F.expr("(end + 1) div 2").alias("end"))


def _gaps(x: Column) -> Column:
    """Junctions: what lies between the blocks of one mate."""
    pairs = F.arrays_zip(F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))).alias("a"), F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))).alias("b"))
    return F.transform(pairs, lambda p: F.struct(p["a"]["end"].alias("start"), p["b"]["start"].alias("end")))


def junctions_conflict(a: Column, b: Column) -> Column:
    """I8's flag for two mates whose blocks overlap: different junctions of the two overlap, or the junctions of one lie over blocks of the other, which has none."""
    ja, jb = _gaps(a), _gaps(b)
    differ = F.exists(ja, lambda x: F.exists(jb, lambda y: ((x["start"] != y["start"]) | (x["end"] != y["end"])) & overlaps(x["start"], x["end"], y["start"], y["end"])))
    one = F.when(F.size(jb) == 0, any_overlap(ja, b)).when(F.size(ja) == 0, any_overlap(a, jb)).otherwise(F.lit(False))
    return any_overlap(a, b) & F.when((F.size(ja) > 0) & (F.size(jb) > 0), differ).otherwise(one)


def merge_blocks(a: Column, b: Column) -> Column:
    """I8: the blocks of a fragment from those of its mates: apart, both in order; overlapping, the hull without the junctions of either. In conflict the
    blocks of the only mate with junctions, or null if both have some."""
    ja, jb = _gaps(a), _gaps(b)
    every = F.array_sort(F.array_distinct(F.concat(ja, jb)))
    lo = F.least(F.array_min(F.transform(a, lambda x: x["start"])), F.array_min(F.transform(b, lambda x: x["start"])))
    hi = F.greatest(F.array_max(F.transform(a, lambda x: x["end"])), F.array_max(F.transform(b, lambda x: x["end"])))
    starts = F.concat(F.array(lo), F.transform(every, lambda x: x["end"]))
    ends = F.concat(F.transform(every, lambda x: x["start"]), F.array(hi))
    hull = F.transform(F.arrays_zip(starts.alias("start"), ends.alias("end")), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    conflict = junctions_conflict(a, b)
    lone = F.when(F.size(jb) == 0, a).when(F.size(ja) == 0, b)
    return F.when(~any_overlap(a, b), F.array_sort(F.concat(a, b))).when(conflict, lone).otherwise(hull)
