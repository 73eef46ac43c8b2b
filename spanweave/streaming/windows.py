"""Structured Streaming (section 2.13): windows, sessions, running dedup, greedy groups, running counters and interval coverage as keyed state.

Every operator takes a streaming frame (most also a static one) with an event time of type TIMESTAMP; ``as_timestamp`` casts one without zone. Late rows
beyond the watermark are dropped by the engine.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanweave.operators.coverage import IntervalMap


def as_timestamp(df: DataFrame, time: str = "ts") -> DataFrame:
    return df.withColumn(time, F.col(time).cast("timestamp"))


def tumbling(df: DataFrame, time: str, size: str, late: str, by: list[str], *aggs: Column) -> DataFrame:
    """Count windows in time: one result per window and key."""
    return _windows(df, F.window(time, size), time, late, by, aggs)


def sliding(df: DataFrame, time: str, size: str, step: str, late: str, by: list[str], *aggs: Column) -> DataFrame:
    return _windows(df, F.window(time, size, step), time, late, by, aggs)


def sessions(df: DataFrame, time: str, gap: str, late: str, by: list[str], *aggs: Column) -> DataFrame:
    """groupby2 with ``end`` in time: rows join while they follow the last one within ``gap``."""
    return _windows(df, F.session_window(time, gap), time, late, by, aggs)


def _windows(df: DataFrame, w: Column, time: str, late: str, by: list[str], aggs: tuple[Column, ...]) -> DataFrame:
    if df.isStreaming:
        df = df.withWatermark(time, late)
    out = df.groupBy(w.alias("w"), *by).agg(*(aggs or (F.count("*").alias("n"),)))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def running_dedup(df: DataFrame, time: str, late: str, keys: list[str]) -> DataFrame:
    """dedup of a stream: the first row of each key within the watermark."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def greedy_groups(df: DataFrame, key: str, time: str, value: str, limit: float) -> DataFrame:
    """groupby2 with ``start``: per key, rows join the open group while value - first value < limit; a null value joins nothing. Rows of one batch are taken by time.

    Every batch gives out the groups it began or grew, the open one included, numbered from 0 within the key (update mode); ``latest_groups`` keeps the last state of each."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        group, first, last, n = state.get if state.exists else (-1, None, None, 0)
        out = []
        rows = pd.concat(list(batches)).sort_values(time, kind="stable")
        changed = False
        for v in rows[value].tolist():
            v = None if pd.isna(v) else float(v)
            if n and first is not None and v is not None and v - first < limit:
                n, last = n + 1, v
            else:
                if changed:
                    out.append((k[0], group, first, last, n))
                group, first, last, n = group + 1, v, v, 1
            changed = True
        out.append((k[0], group, first, last, n))
        state.update((group, first, last, n))
        yield pd.DataFrame(out, columns=[key, "group", "first", "last", "n"]).astype({"first": "float64", "last": "float64"})

    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).applyInPandasWithState(
        run, f"{key} {kind}, group long, first double, last double, n long", "group long, first double, last double, n long", "update", GroupStateTimeout.NoTimeout
    )


def latest_groups(updates: DataFrame, key: str) -> DataFrame:
    """The groups of ``greedy_groups`` from its collected updates: a group only grows, so its largest state is its last."""
    return updates.groupBy(key, "group").agg(F.max_by(F.struct("first", "last", "n"), "n").alias("_g")).select(key, "group", "_g.*")


def running_names(df: DataFrame, name: str, time: str, order: str | None = None) -> DataFrame:
    """rename of a stream: the n-th row of a name becomes ``name_n``; rows of one batch are taken by time, then ``order`` (a unique column; without it rows of one time come as they arrive)."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values([time, order] if order else [time], kind="stable").reset_index(drop=True)
        rows[name] = [x if seen + i == 0 else f"{x}_{seen + i + 1}" for i, x in enumerate(rows[name])]
        state.update((seen + len(rows),))
        yield rows

    return df.groupBy(name).applyInPandasWithState(run, df.schema, "seen long", "append", GroupStateTimeout.NoTimeout)


def coverage_updates(df: DataFrame, keys: list[str], tile: int = 1 << 18) -> DataFrame:
    """Problem 5 as a stream: the disjoint-interval map of each key and tile is its state; every batch gives out the stretches of the tiles it changed, whole (update mode). Tiles hold what
    starts in them; ``spanweave.operators.coverage`` joins them across tiles."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m = IntervalMap(*state.get) if state.exists else IntervalMap()
        for b in batches:
            for s, e in zip(b["start"].tolist(), b["end"].tolist()):
                m.add(s, e)
        state.update((m.starts, m.ends))
        yield pd.DataFrame({**{c: [v] * len(m) for c, v in zip([*keys, "tile"], k)}, "span_start": m.starts, "span_end": m.ends})

    ok = "start IS NOT NULL AND end IS NOT NULL AND end > start AND " + " AND ".join(f"{k} IS NOT NULL" for k in keys)
    rows = df.where(ok).select(*keys, F.floor(F.col("start") / tile).alias("tile"), F.col("start").cast("bigint"), F.col("end").cast("bigint"))
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return rows.groupBy(*keys, "tile").applyInPandasWithState(
        run, f"{kinds}, tile long, span_start long, span_end long", "starts array<long>, ends array<long>", "update", GroupStateTimeout.NoTimeout
    )
