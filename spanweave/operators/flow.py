"""Ordered-stream operators over DataFrames (D1-D30, W1, O1). Each takes the frame and, where order matters, the name of a unique order column.

Frames have no order of their own, so "first", "consecutive" and "window" always follow ``order``. Operators that look only at neighbours run without a
global single-task window: rows are range-partitioned by the order column, and partitions learn what precedes them from one summary row each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spanweave.runtime import attach, cut


def _true(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def _in_order(order: str, value: str) -> Column:
    """The values of a group in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda s: s["v"])


def keep(df: DataFrame, cond: Column) -> DataFrame:
    """D1 filter."""
    return df.where(cond)


def skip_while(df: DataFrame, cond: Column) -> DataFrame:
    """Drops every row that meets ``cond``; a null condition keeps the row."""
    return df.where(~_true(cond))


def _first_false(df: DataFrame, cond: Column, order: str) -> DataFrame:
    return df.agg(F.min(F.when(~_true(cond), F.col(order))).alias("_stop"))  # one row


def take_while(df: DataFrame, cond: Column, order: str) -> DataFrame:
    """D3: the rows before the first that fails ``cond`` (null fails)."""
    return df.transform(attach, _first_false(df, cond, order)).where(F.col("_stop").isNull() | (F.col(order) < F.col("_stop"))).drop("_stop")


def drop_while(df: DataFrame, cond: Column, order: str) -> DataFrame:
    """The rows from the first that fails ``cond``."""
    return df.transform(attach, _first_false(df, cond, order)).where(F.col(order) >= F.col("_stop")).drop("_stop")


def mapwith(df: DataFrame, **columns: Column) -> DataFrame:
    """D5."""
    return df.withColumns(columns)


def transform(df: DataFrame, func: Callable[..., DataFrame], *args, **kwargs) -> DataFrame:
    """A function of the whole frame."""
    return func(df, *args, **kwargs)


def peek(df: DataFrame, name: str, *metrics: Column) -> DataFrame:
    """D7 apply: named metrics as rows pass."""
    return df.observe(name, *metrics)


def for_each(df: DataFrame, func: Callable) -> None:
    """A side effect per row, on the executors."""
    df.foreach(func)


def flatten(df: DataFrame, column: str, depth: int = 1, order: str | None = None) -> DataFrame:
    """One row per element of ``depth`` levels of arrays; ``order`` becomes (order, place) as struct. Null and empty arrays give no row."""
    x = reduce(lambda c, _: F.flatten(c), range(depth - 1), F.col(column))
    if order is None:
        return df.withColumn(column, F.explode(x))
    rest = [c for c in df.columns if c not in (column, order)]
    return df.select(*rest, order, F.posexplode(x).alias("_at", column)).withColumn(order, F.struct(order, "_at")).drop("_at")


def concat(a: DataFrame, b: DataFrame, order: str | None = None) -> DataFrame:
    """Rows of a, then of b; order values of b follow those of a."""
    if order is None:
        return a.unionByName(b)
    top = a.agg((F.coalesce(F.max(order), F.lit(-1)) + 1).alias("_top"))
    low = b.agg(F.coalesce(F.min(order), F.lit(0)).alias("_low"))
    moved = b.transform(attach, top).transform(attach, low).withColumn(order, F.col(order) - F.col("_low") + F.col("_top")).drop("_top", "_low")
    return a.unionByName(moved)


def numbered(df: DataFrame, order: str, name: str = "_n") -> DataFrame:
    """Dense positions from 0 in the order of ``order``: a range-partitioned sort and one offset per partition."""
    placed = cut(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id")
    sizes = placed.groupBy("_part").count()
    first = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_first"))  # a row per partition
    return placed.join(F.broadcast(first), "_part").withColumn(name, F.col("_first") + F.col("_at")).drop("_part", "_at", "_first")


def islice(df: DataFrame, order: str, start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
    """D12."""
    out = numbered(df, order)
    ok = (F.col("_n") >= start) & ((F.col("_n") - start) % step == 0)
    return out.where(ok if stop is None else ok & (F.col("_n") < stop)).drop("_n")


def head(df: DataFrame, order: str, n: int = 10) -> DataFrame:
    """D13."""
    return df.orderBy(order).limit(n)


def tail(df: DataFrame, order: str, n: int = 10) -> DataFrame:
    """The last n, in order."""
    return df.orderBy(F.col(order).desc()).limit(n).orderBy(order)


def skip(df: DataFrame, order: str, n: int) -> DataFrame:
    """All but the first n."""
    last = df.select(order).orderBy(order).limit(n).agg(F.max(order).alias("_last"), F.count("*").alias("_c"))
    return df.transform(attach, last).where((F.col("_c") == 0) | (F.col(order) > F.col("_last"))).drop("_last", "_c") if n > 0 else df


def dedup(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """D16, A1f: the first row of each key (null is a key like any other); the rows meet as partial minima before they move."""
    rest = [c for c in df.columns if c not in key]
    one = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r"))
    return one.select(*key, "_r.*").select(*df.columns)


def _before(df: DataFrame, order: str, what: list[str]) -> DataFrame:
    """``_has`` and ``_p_<column>``: the values of the row before, without one task for all rows."""
    n = numbered(df, order)
    previous = n.select((F.col("_n") + 1).alias("_n"), F.lit(True).alias("_has"), *[F.col(c).alias("_p_" + c) for c in what])
    return n.join(previous, "_n", "left").withColumn("_has", F.coalesce("_has", F.lit(False)))


def uniq(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row of each run of equal keys, the first."""
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col("_p_" + k)) for k in key])
    return _before(df, order, key).where(~(F.col("_has") & same)).select(*df.columns)


def count(df: DataFrame, func: Callable[[Column], Column] | None = None) -> DataFrame:
    """D18."""
    n = F.count("*")
    return df.agg((func(n) if func else n).alias("count"))


def permutations(df: DataFrame, value: str, order: str, r: int = 2) -> DataFrame:
    """Ordered choices of ``r`` rows of a small set: v0, v1, ...; its output, not a search, has n!/(n-r)! rows."""
    out = df.select(F.col(value).alias("v0"), F.array(order).alias("_used"))
    for i in range(1, r):
        out = out.crossJoin(df.select(F.col(value).alias(f"v{i}"), F.col(order).alias("_o"))).where(~F.array_contains("_used", F.col("_o"))).withColumn("_used", F.array_append("_used", F.col("_o"))).drop("_o")
    return out.drop("_used")


def join_text(df: DataFrame, value: str, order: str, separator: str = ", ", by: list[str] | None = None) -> DataFrame:
    """Values as one string, per group of ``by``."""
    x = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value].cast("string"))
    return df.groupBy(*(by or [])).agg(F.array_join(x, separator).alias("joined"))


def run_ids(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """``run``: the order value at which each run of equal keys begins. Partitions sorted by order carry the last begin over through one row each."""
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col("_p_" + k)) for k in key])
    marked = _before(df, order, key).withColumn("_new", ~(F.col("_has") & same)).drop("_has", *["_p_" + k for k in key])
    return _carry(marked, order, F.when(F.col("_new"), F.col(order)), "run").drop("_new", "_n")


def _carry(df: DataFrame, order: str, value: Column, name: str, block: int = 1 << 16) -> DataFrame:
    """The last non-null ``value`` up to each row; ``_n`` holds dense positions."""
    df = df.withColumn("_v", value).withColumn("_block", F.expr(f"_n div {block}"))
    last = df.groupBy("_block").agg(F.max_by(F.when(F.col("_v").isNotNull(), F.col("_v")), F.when(F.col("_v").isNotNull(), F.col("_n"))).alias("_l"))
    last = last.select("_block", F.last("_l", True).over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)).alias("_in"))  # a row per block
    inside = Window.partitionBy("_block").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    return df.join(last, "_block").withColumn(name, F.coalesce(F.last("_v", True).over(inside), F.col("_in"))).drop("_v", "_block", "_in")


def kgroupby(df: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """(key, values) of each run of equal keys, ``run`` being where it begins."""
    return run_ids(df, key, order).groupBy("run", *key).agg(_in_order(order, value).alias("values"))


def groupby2_end(df: DataFrame, together: Callable[[Column, Column], Column], value: str, order: str) -> DataFrame:
    """D23, ``end``: a row joins the group while ``together(last value, value)`` holds."""
    marked = _before(df, order, [value]).withColumn("_new", ~(F.col("_has") & _true(together(F.col("_p_" + value), F.col(value)))))
    runs = _carry(marked, order, F.when(F.col("_new"), F.col(order)), "run")
    return runs.groupBy("run").agg(_in_order(order, value).alias("values"))


def groupby2_start(df: DataFrame, together: Callable[[object, object], bool], value: str, order: str, by: list[str]) -> DataFrame:
    """D23, ``start``: (by, group, values): a row joins while ``together(first value of the group, value)`` holds; a null value joins nothing and is joined by none.

    Greedy by nature, so the rows of one key pass through one task, in order and one at a time; only the open group is held. ``together`` takes plain values.
    """
    kind = df.schema[value].dataType
    schema = T.StructType([*[df.schema[c] for c in by], T.StructField("group", T.IntegerType()), T.StructField("values", T.ArrayType(kind))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        group, values = 0, []
        out: list[tuple] = []
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            for *k, v in zip(*columns):
                k = tuple(k)
                if key == k and v is not None and values[0] is not None and together(values[0], v):
                    values.append(v)
                    continue
                if key is not None:
                    out.append((*key, group, values))
                key, group, values = k, group + 1 if key == k else 0, [v]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), arrow)], schema=arrow)
                out = []
        if key is not None:
            out.append((*key, group, values))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), arrow)], schema=arrow)

    return df.repartition(*by).sortWithinPartitions(*by, order).select(*by, value).mapInArrow(run, schema)


def sort(df: DataFrame, key: list[str], order: str, reverse: bool = False) -> DataFrame:
    """Stable, also in reverse."""
    return df.orderBy(*[F.col(k).desc() if reverse else F.col(k).asc() for k in key], order)


def reverse(df: DataFrame, order: str) -> DataFrame:
    """D25."""
    return df.orderBy(F.col(order).desc())


def transpose(df: DataFrame, column: str, order: str) -> DataFrame:
    """(pos, values): the n-th elements of every row's array, down to the shortest."""
    short = df.agg(F.min(F.size(column)).alias("_min"))
    cells = df.select(order, F.posexplode(column).alias("pos", "v")).transform(attach, short).where("pos < _min")
    return cells.groupBy("pos").agg(_in_order(order, "v").alias("values"))


def window(df: DataFrame, value: str, order: str, size: int = 2, step: int = 1) -> DataFrame:
    """(start, values): count windows. Full windows every ``step`` rows; then, if rows are left that no full window began at, one short window of what follows
    the last full one after its step; an input shorter than ``size`` is one short window; an empty one gives none."""
    n = numbered(df.select(*dict.fromkeys([order, value])), order)
    total = n.agg(F.count("*").alias("_c"))
    full = F.when(F.col("_c") >= size, F.expr(f"(_c - {size}) div {step}") + 1).otherwise(0)
    ahead = F.explode(F.sequence(F.greatest(F.expr(f"-((-(_n - {size - 1})) div {step})"), F.lit(0)), F.expr(f"_n div {step}")))
    rows = n.transform(attach, total).withColumn("_full", full).withColumn("_w", ahead)
    rows = rows.where((F.col("_n") >= F.col("_w") * step) & (F.col("_n") < F.col("_w") * step + size) & (F.col("_w") <= F.col("_full")))
    out = rows.groupBy("_w", "_full", "_c").agg(_in_order("_n", value).alias("values"))
    seen = F.when(F.col("_full") > 0, (F.col("_full") - 1) * step + size).otherwise(0)
    return out.where((F.col("_w") < F.col("_full")) | (seen < F.col("_c"))).select((F.col("_w") * step).alias("start"), "values")


def around(df: DataFrame, cond: Column, order: str, before: int = 1, after: int = 1) -> DataFrame:
    """D28 round: for every row that meets ``cond``, the rows from ``before`` ahead of it to ``after`` behind it; ``match`` is its position."""
    n = numbered(df, order)
    hits = n.where(cond).select(F.col("_n").alias("match"), F.explode(F.sequence(F.col("_n") - before, F.col("_n") + after)).alias("_n"))
    return n.join(hits, "_n").drop("_n")


def nothing(df: DataFrame) -> DataFrame:
    """D29."""
    return df
