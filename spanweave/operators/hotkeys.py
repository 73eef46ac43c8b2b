"""Problem 3: per-key results where a few keys hold most rows, without tasks that outlast the rest.

Dense accumulator arrays: the distinct keys get dense codes (a dictionary); every input split, whatever keys it holds, scatters its rows into
arrays indexed by code; the arrays travel as blocks of fixed length and are summed in two levels, first over groups of splits, then over
the groups. No row is moved by its key, so a key that holds a third of all rows costs each split as much as any other key.

A dictionary of at most ``BROADCAST_KEYS`` keys and ``BROADCAST_BYTES`` bytes (both checked) travels to the tasks, which then encode rows directly.
Beyond that each split keeps a dictionary of its own, emptied whenever it holds ``LOCAL_KEYS`` keys, and joins its
partial results (one row per key and split at most, no hot key left) with the codes.

Defined results: rows with a null key count for no key; null measures count as rows but not in extents, which are null where no row has a value;
an empty table gives no keys; the empty string is a key; keys come out as strings; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanweave.runtime import cut

BROADCAST_KEYS, BROADCAST_BYTES = 200_000, 8 << 20
LOCAL_KEYS = 200_000
#: Codes in a block of an accumulator array, and splits whose blocks are summed first.
BLOCK, FAN = 1024, 64
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_ARRAYS = "n array<bigint>, lo array<bigint>, hi array<bigint>"


def dictionary(df: DataFrame, key: str) -> DataFrame:
    """(key, code): the distinct non-null keys with codes from 0 on, dense and in the keys' order, without a single-task sort."""
    part = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    keys = df.select(key).where(F.col(key).isNotNull()).distinct().repartitionByRange(key).sortWithinPartitions(key)
    keys = cut(keys.withColumn("_id", F.monotonically_increasing_id()).select(key, F.shiftright("_id", 33).alias("_part"), part.alias("_at")))
    sizes = keys.groupBy("_part").count()  # one row per partition
    first = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_first"))
    return keys.join(F.broadcast(first), "_part").select(key, (F.col("_first") + F.col("_at")).alias("code"))


def _scatter(codes: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray, acc: dict[int, list[np.ndarray]]) -> None:
    """Scatter-reduce rows into the blocks of ``acc``."""
    block = codes // BLOCK
    order = np.argsort(block, kind="stable")
    codes, n, lo, hi, block = codes[order], n[order], lo[order], hi[order], block[order]
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else []
    for s, e in zip(starts, [*starts[1:], len(block)]):
        a = acc.get(int(block[s]))
        if a is None:
            a = acc[int(block[s])] = [np.zeros(BLOCK, np.int64), np.full(BLOCK, _HIGH), np.full(BLOCK, _LOW)]
        at = codes[s:e] % BLOCK
        np.add.at(a[0], at, n[s:e])
        np.minimum.at(a[1], at, lo[s:e])
        np.maximum.at(a[2], at, hi[s:e])


def _blocks(acc: dict[int, list[np.ndarray]], more: dict[str, int]) -> Iterator[pa.RecordBatch]:
    ids = sorted(acc)
    for i in range(0, len(ids), 256):
        some = ids[i : i + 256]
        offsets = pa.array(np.arange(0, (len(some) + 1) * BLOCK, BLOCK, dtype=np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([acc[b][k] for b in some]))) for k in range(3)]
        yield pa.RecordBatch.from_arrays([*[pa.array([v] * len(some), pa.int64()) for v in more.values()], pa.array(some, pa.int64()), *lists], names=[*more, "block", "n", "lo", "hi"])


def _sum_blocks(table: pa.Table) -> pa.Table:
    """The sum of all arrays of one block."""
    size = len(table)
    a = [table.column(k).combine_chunks().flatten().to_numpy().reshape(size, BLOCK) for k in ("n", "lo", "hi")]
    one = pa.array(np.array([0, BLOCK], np.int32))
    lists = [pa.ListArray.from_arrays(one, pa.array(x)) for x in (a[0].sum(0), a[1].min(0), a[2].max(0))]
    return pa.Table.from_arrays([table.column("block").slice(0, 1), *lists], names=["block", "n", "lo", "hi"])


def _measures(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    lo = pc.fill_null(b.column(1).cast(pa.int64()), _HIGH).to_numpy(zero_copy_only=False)
    hi = pc.fill_null(b.column(2).cast(pa.int64()), _LOW).to_numpy(zero_copy_only=False)
    return lo, hi


def key_profile(df: DataFrame, key: str, low: str | None = None, high: str | None = None, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(key, n_rows, min_low, max_high) of each non-null key: rows, smallest ``low`` and largest ``high`` (whole numbers)."""
    spark = df.sparkSession
    none = F.lit(None).cast("bigint")
    rows = df.select(F.col(key).cast("string").alias("k"), (F.col(low).cast("bigint") if low else none).alias("lo"), (F.col(high).cast("bigint") if high else none).alias("hi"))
    codes = cut(dictionary(rows, "k"))
    size = codes.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("k")), F.lit(0)).alias("b")).first()
    if size.n <= broadcast_keys and size.b <= BROADCAST_BYTES:
        words = codes.toArrow()  # at most BROADCAST_KEYS rows
        known = spark.sparkContext.broadcast(words.column("k").take(pc.sort_indices(words.column("code"))).combine_chunks().to_pylist())

        def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            acc: dict[int, list[np.ndarray]] = {}
            values = pa.array(known.value, pa.string())
            for b in batches:
                at = pc.index_in(b.column(0).cast(pa.string()), value_set=values)
                if at.null_count:
                    b, at = b.filter(pc.is_valid(at)), at.drop_null()
                code = at.to_numpy().astype(np.int64)
                if len(values) <= BLOCK:  # one block: counts by bincount
                    if 0 not in acc:
                        acc[0] = [np.zeros(BLOCK, np.int64), np.full(BLOCK, _HIGH), np.full(BLOCK, _LOW)]
                    acc[0][0] += np.bincount(code, minlength=BLOCK)
                    if low or high:
                        lo, hi = _measures(b)
                        np.minimum.at(acc[0][1], code, lo)
                        np.maximum.at(acc[0][2], code, hi)
                else:
                    lo, hi = _measures(b)
                    _scatter(code, np.ones(len(code), np.int64), lo, hi, acc)
            yield from _blocks(acc, {"g": TaskContext.get().partitionId() // FAN})

        parts = rows.where(F.col("k").isNotNull()).mapInArrow(direct, f"g bigint, block bigint, {_ARRAYS}")
    else:

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            acc: dict[int, list[np.ndarray]] = {}
            codes_of: dict[str, int] = {}
            part = TaskContext.get().partitionId() // FAN

            def out() -> Iterator[pa.RecordBatch]:
                names = pa.array(list(codes_of), pa.string())
                a = [np.concatenate([acc[b][k] for b in sorted(acc)])[: len(names)] for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), part)), names, *map(pa.array, a)], names=["g", "k", "n", "lo", "hi"])

            for b in batches:
                words = pc.dictionary_encode(b.column(0).cast(pa.string()))
                here = np.array([codes_of.setdefault(x, len(codes_of)) for x in words.dictionary.to_pylist()], np.int64)
                lo, hi = _measures(b)
                code = here[words.indices.to_numpy()]
                _scatter(code, np.ones(len(code), np.int64), lo, hi, acc)
                if len(codes_of) >= LOCAL_KEYS:
                    yield from out()
                    acc.clear()
                    codes_of.clear()
            if codes_of:
                yield from out()

        def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            acc: dict[int, list[np.ndarray]] = {}
            now = None
            for b in batches:  # sorted by g and block
                g = b.column("g").to_numpy()
                cuts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else []
                for s, e in zip(cuts, [*cuts[1:], len(g)]):
                    if now is not None and now != int(g[s]) or len(acc) >= 512:
                        yield from _blocks(acc, {"g": now})
                        acc.clear()
                    now = int(g[s])
                    _scatter(*[b.column(c).to_numpy()[s:e] for c in ("code", "n", "lo", "hi")], acc)
            if acc:
                yield from _blocks(acc, {"g": now})

        sums = rows.where(F.col("k").isNotNull()).mapInArrow(local, "g bigint, k string, n bigint, lo bigint, hi bigint")
        placed = sums.join(codes, "k").withColumn("block", F.expr(f"code div {BLOCK}")).select("g", "block", "code", "n", "lo", "hi")
        parts = placed.repartition("g", "block").sortWithinPartitions("g", "block").mapInArrow(encoded, f"g bigint, block bigint, {_ARRAYS}")
    schema = f"block bigint, {_ARRAYS}"
    some = parts.groupBy("g", "block").applyInArrow(_sum_blocks, schema)
    total = some.groupBy("block").applyInArrow(_sum_blocks, schema)
    cells = total.select("block", F.posexplode(F.arrays_zip("n", "lo", "hi")).alias("at", "x")).where("x.n > 0")
    found = cells.select((F.col("block") * BLOCK + F.col("at")).alias("code"), "x.*").join(codes, "code")
    return found.select(
        F.col("k").alias(key),
        F.col("n").alias("n_rows"),
        F.when(F.col("lo") != _HIGH, F.col("lo")).alias("min_low"),
        F.when(F.col("hi") != _LOW, F.col("hi")).alias("max_high"),
    )


def distinct_per_key(df: DataFrame, key: str, value: str, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(key, n_distinct): distinct non-null values of each key. Pairs are made distinct first, moved by the whole pair, then counted as rows."""
    pairs = df.select(F.col(key), F.col(value)).where(F.col(key).isNotNull() & F.col(value).isNotNull()).distinct()
    return key_profile(cut(pairs), key, broadcast_keys=broadcast_keys).select(key, F.col("n_rows").alias("n_distinct"))


def key_results(df: DataFrame, key: str, low: str | None, high: str | None, member: str) -> DataFrame:
    """(key, n_rows, min_low, max_high, n_members) of each key."""
    return key_profile(df, key, low, high).join(distinct_per_key(df, key, member), key, "left").withColumn("n_members", F.coalesce("n_distinct", F.lit(0).cast("bigint"))).drop("n_distinct")


def heavy_keys(df: DataFrame, key: str, name: str, share: float = 0.05) -> DataFrame:
    """(field_name, key_value): keys that hold at least ``share`` of all rows, rows with a null key among all."""
    every = df.agg(F.count("*")).scalar()  # a scalar subquery
    got = key_profile(df, key).where(F.col("n_rows") >= F.lit(share) * every)
    return got.select(F.lit(name).alias("field_name"), F.col(key).alias("key_value"))
