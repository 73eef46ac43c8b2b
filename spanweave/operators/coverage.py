"""Problem 5: overlapping intervals merged into stretches, and the gaps between these.

An ordered map of disjoint intervals is the keyed state: each insertion finds the overlapped ones by binary search, replaces them by their union and
thereby closes or narrows gaps. A key (chrom and strand) may hold a third of all rows, so its line is cut into tiles of fixed width and the state is kept per
tile, by the start of the interval; splits first merge what they hold, so that repeated and nested intervals do not move.
A tile's map has at most TILE / 2 entries. Across tiles only summaries meet: the furthest end so far, and the heads that
reach in from earlier tiles, by windows over one short row per tile. `spanweave.streaming` keeps the same map as state of a stream.

Defined results: rows with a null key, start or end take no part, nor do empty and reversed intervals; touching intervals join; repeats
count once; an empty table gives no rows; negative starts are allowed.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanweave.runtime import cut

TILE = 1 << 18
#: Intervals that a split holds at once before it gives out what it merged.
HELD = 500_000


class IntervalMap:
    """Disjoint intervals in order; touching ones are one."""

    __slots__ = ("ends", "starts")

    def __init__(self, starts: list[int] | None = None, ends: list[int] | None = None) -> None:
        self.starts, self.ends = list(starts or ()), list(ends or ())

    def add(self, start: int, end: int) -> None:
        if end <= start:
            return
        starts, ends = self.starts, self.ends
        if not starts or start > ends[-1]:
            starts.append(start)
            ends.append(end)
            return
        i = bisect_left(ends, start)  # first that ends at start or later
        j = bisect_right(starts, end)  # first that starts after end
        if i < j:
            if starts[i] <= start and ends[i] >= end:
                return
            start, end = min(start, starts[i]), max(end, ends[j - 1])
        starts[i:j] = [start]
        ends[i:j] = [end]

    def gaps(self) -> list[tuple[int, int]]:
        return list(zip(self.ends[:-1], self.starts[1:]))

    def __len__(self) -> int:
        return len(self.starts)


def _tile_maps(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tile, starts, ends: the state of each tile; a row per tile."""
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    n = len(keys)

    def early(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, IntervalMap] = {}
        types: list[pa.DataType] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            cols: list[list] = [[] for _ in range(n + 3)]
            for k, m in held.items():
                for i in range(n + 1):
                    cols[i].extend([k[i]] * len(m))
                cols[n + 1].extend(m.starts)
                cols[n + 2].extend(m.ends)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [*types, pa.int64(), pa.int64(), pa.int64()])], names=[*keys, "tile", "s", "e"])

        for b in batches:
            types[:] = b.schema.types[:n]
            for *k, s, e in zip(*[c.to_pylist() for c in b.columns]):
                m = held.get(key := (*k, s // TILE))
                if m is None:
                    m = held[key] = IntervalMap()
                m.add(s, e)
            size += len(b)
            if size >= HELD:
                size = sum(map(len, held.values()))
                if size >= HELD // 2:
                    yield from out()
                    held.clear()
                    size = 0
        yield from out()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, IntervalMap()
        types: list[pa.DataType] = []
        done: list[tuple] = []

        def out() -> pa.RecordBatch:
            cols = list(zip(*done))
            done.clear()
            return pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(cols[:-2], [*types, pa.int64()])], *[pa.array(c, pa.list_(pa.int64())) for c in cols[-2:]]], names=[*keys, "tile", "starts", "ends"])

        for b in batches:  # sorted by keys and tile
            types[:] = b.schema.types[:n]
            for *k, s, e in zip(*[c.to_pylist() for c in b.columns]):
                if k != now:
                    if now is not None:
                        done.append((*now, state.starts, state.ends))
                    now, state = k, IntervalMap()
                    if len(done) >= 64:
                        yield out()
                state.add(s, e)
        if now is not None:
            done.append((*now, state.starts, state.ends))
        if done:
            yield out()

    first = rows.mapInArrow(early, f"{kinds}, tile bigint, s bigint, e bigint")
    moved = first.repartition(*keys, "tile").sortWithinPartitions(*keys, "tile")
    return moved.mapInArrow(keyed, f"{kinds}, tile bigint, starts array<bigint>, ends array<bigint>")


def stretches(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """keys, kind, span_start, span_end: ``merged`` for each maximal covered stretch, ``gap`` for each uncovered one between neighbours of a key."""
    ok = F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) > F.col(start))
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    given, keys = keys, [f"_key{i}" for i in range(len(keys))]
    rows = df.where(ok).select(*[F.col(g).alias(k) for g, k in zip(given, keys)], F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("e"))
    tiles = cut(_tile_maps(rows, keys))
    order = Window.partitionBy(*keys).orderBy("tile")
    reach = tiles.select(*keys, "tile", F.element_at("ends", -1).alias("last")).select(
        *keys, "tile", F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("reach")
    )
    both = F.arrays_zip("starts", "ends")
    inside = F.col("reach").isNotNull()
    heads = F.filter(both, lambda x: inside & (x.starts <= F.col("reach")))
    own = F.filter(both, lambda x: ~inside | (x.starts > F.col("reach")))
    per_tile = cut(tiles.join(reach, [*keys, "tile"]).select(*keys, "tile", F.array_max(F.transform(heads, lambda x: x.ends)).alias("head"), own.alias("own")))
    # runs that end within their tile, and the gaps after them
    n = F.size("own")
    pairs = F.arrays_zip(F.slice("own", 1, F.greatest(n - 1, F.lit(0))).alias("a"), F.slice("own", 2, F.greatest(n - 1, F.lit(0))).alias("b"))
    inner = per_tile.where(n > 1).select(*keys, F.explode(pairs).alias("x"))
    both_kinds = F.array(
        F.struct(F.lit("merged").alias("kind"), F.col("x.a.starts").alias("span_start"), F.col("x.a.ends").alias("span_end")),
        F.struct(F.lit("gap").alias("kind"), F.col("x.a.ends").alias("span_start"), F.col("x.b.starts").alias("span_end")),
    )
    inner = inner.select(*keys, F.explode(both_kinds).alias("y")).select(*keys, "y.*")
    # the last run of each tile goes on through the heads of later tiles
    has = (n > 0).cast("int")
    short = per_tile.select(*keys, "tile", "head", has.alias("has"), F.get("own", F.lit(0)).starts.alias("first"), F.get("own", n - 1).alias("open"))
    short = short.withColumn("run", F.sum("has").over(order))
    ends = short.select(*keys, F.explode(F.array(F.struct((F.col("run") - F.col("has")).alias("run"), F.col("head").alias("e")), F.struct(F.col("run"), F.col("open.ends").alias("e")))).alias("z"))
    ends = ends.select(*keys, "z.*").where("e IS NOT NULL").groupBy(*keys, "run").agg(F.max("e").alias("span_end"))
    opened = short.where("has = 1").select(*keys, "run", F.col("open.starts").alias("span_start"), F.lead("first").over(order).alias("next"))
    outer = opened.join(ends, [*keys, "run"])
    both_kinds = F.array(
        F.struct(F.lit("merged").alias("kind"), F.col("span_start"), F.col("span_end")),
        F.struct(F.lit("gap").alias("kind"), F.col("span_end").alias("span_start"), F.col("next").alias("span_end")),
    )
    outer = outer.select(*keys, F.explode(both_kinds).alias("y")).select(*keys, "y.*").where(F.col("span_end").isNotNull())
    return inner.unionByName(outer).select("kind", *[F.col(k).alias(g) for g, k in zip(given, keys)], "span_start", "span_end")
