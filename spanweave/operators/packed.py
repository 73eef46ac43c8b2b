"""Problem 2: several values packed in one field, split into one row per value with its position.

Dictionary-guided segmentation. A multi-pattern automaton finds every occurrence of the known patterns: whole values, separators,
quotes and white space. Dynamic programming then picks the cover of the field that leaves the fewest characters to unknown pieces and,
among those, uses the fewest arcs. A known value that holds separator characters is thereby protected: it wins over the cut through it.

Defined results: null and empty fields give no rows; quotes never belong to a value; a run of white space separates, and
white space beside another separator belongs to that one; white space at either end of a field is no separator; an empty piece keeps its position without
a row; a separator at the end opens no position; repeated rows of the input give repeated rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What stands between values.
SEPARATORS = (",", ";", ":", "|", "/", "，")
QUOTES = ('"', "'")
SPACES = " \t\n\r\x0b\x0c\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Known whole values of block lists: the whole numbers below this one, besides the place-holders for a missing value.
KNOWN_NUMBERS = 10_000
PLACE_HOLDERS = ("nil", "NA", "?", "-", ".")

#: A whole number. ``-`` before nothing but zeros is the place-holder filled up with zeros, as in 0nil or 00NA.
WHOLE = r"^(?:\+?[0-9]+|-0*[1-9][0-9]*)\z"
_VALUE, _SEPARATOR, _QUOTE, _SPACE, _UNKNOWN = range(5)


def segmenter(known: Iterable[str], separators: Iterable[str] = SEPARATORS, quotes: Iterable[str] = QUOTES) -> Callable[[str], list[str]]:
    """A function from a field to its pieces in order, empty pieces included."""
    machine = ahocorasick.Automaton()
    for x in known:
        if x:
            machine.add_word(x, (_VALUE, len(x)))
    for kind, some in ((_SEPARATOR, separators), (_QUOTE, quotes), (_SPACE, SPACES)):
        for x in some:
            machine.add_word(x, (kind, len(x)))
    machine.make_automaton()

    def pieces(field: str) -> list[str]:
        n = len(field)
        marks: list[tuple[int, int] | None] = [None] * (n + 1)  # at its start: kind and end of a delimiter
        values: list[list[int]] = [[] for _ in range(n + 1)]  # at its end: starts of known values
        for last, (kind, size) in machine.iter(field):
            start = last + 1 - size
            if kind == _VALUE:
                values[last + 1].append(start)
            elif marks[start] is None or marks[start][1] < last + 1:
                marks[start] = (kind, last + 1)
        edge = [True] * (n + 1)  # may a value end before, or start at, this place
        closes = [False] * (n + 1)
        for i, m in enumerate(marks):
            if m:
                closes[m[1]] = True
        for i in range(1, n):
            edge[i] = marks[i] is not None or closes[i]
        # cost: (characters in unknown pieces, arcs); back: (start, kind)
        far = (n + 1, n + 1)
        cost: list[tuple[int, int]] = [far] * (n + 1)
        back: list[tuple[int, int]] = [(0, _UNKNOWN)] * (n + 1)
        cost[0], run = (0, 0), 0  # run: where the unknown piece that ends here may start at the earliest
        for i in range(n + 1):
            if i and edge[i]:
                for s in values[i]:
                    if edge[s] and (c := (cost[s][0], cost[s][1] + 1)) < cost[i]:
                        cost[i], back[i] = c, (s, _VALUE)
                if run < i and cost[run] != far and (c := (cost[run][0] + i - run, cost[run][1] + 1)) < cost[i]:
                    cost[i], back[i] = c, (run, _UNKNOWN)
            if i < n and (m := marks[i]):
                kind, end = m
                if (c := (cost[i][0], cost[i][1] + 1)) < cost[end]:
                    cost[end], back[end] = c, (i, kind)
                run = end
        arcs = []
        i = n
        while i:
            s, kind = back[i]
            arcs.append((kind, field[s:i]))
            i = s
        out: list[str] = []
        now: list[str] = []
        gap = opened = False  # white space since the last value; a separator awaits its value
        for kind, x in reversed(arcs):
            if kind == _SPACE:
                gap = True
            elif kind == _SEPARATOR:
                out.append("".join(now))
                now, gap, opened = [], False, True
            elif kind != _QUOTE:
                if gap and now:
                    out.append("".join(now))
                    now = []
                now.append(x)
                gap = opened = False
        if now:
            out.append("".join(now))
        return out

    return pieces


def block_values() -> list[str]:
    return [*map(str, range(KNOWN_NUMBERS)), *PLACE_HOLDERS]



def split_packed(df: DataFrame, key: str, fields: list[str], known: list[str] | None = None) -> DataFrame:
    """(key, field_name, pos, piece) for each piece that is not empty of the string columns ``fields``.

    ``known`` is a dictionary of fixed size that travels with the tasks; values beyond it are found as unknown pieces.
    """
    if key in ("field_name", "pos", "piece"):
        raise ValueError(f"the key may not be called {key}")
    words = block_values() if known is None else list(known)
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("field_name", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("piece", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = segmenter(words)
        for b in batches:
            for name in fields:
                rows, pos, got = [], [], []
                for r, x in enumerate(b.column(name).to_pylist()):
                    for p, piece in enumerate(cutter(x) if x else ()):
                        if piece:
                            rows.append(r)
                            pos.append(p)
                            got.append(piece)
                if rows:
                    ids = b.column(0).take(pa.array(rows, pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([name] * len(rows), pa.string()), pa.array(pos, pa.int64()), pa.array(got, pa.string())], names=[key, "field_name", "pos", "piece"])

    return df.select(key, *fields).mapInArrow(run, schema)


def block_list(bed12: DataFrame) -> DataFrame:
    """(bed_id, field_name, pos, val): each integer of blockSizes and blockStarts; an integer beyond 64 bits gives no row."""
    got = split_packed(bed12, "bed_id", ["blockSizes", "blockStarts"])
    return got.where(F.col("piece").rlike(WHOLE)).select("bed_id", "field_name", "pos", F.expr("try_cast(piece AS BIGINT)").alias("val")).where(F.col("val").isNotNull())


def with_pieces(df: DataFrame, fields: list[str]) -> DataFrame:
    """``df`` with each string column of ``fields`` as the array of its pieces in order, empty pieces included; null stays null. Every row stays one row."""
    words = block_values()
    schema = T.StructType([T.StructField(f.name, T.ArrayType(T.StringType())) if f.name in fields else f for f in df.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = segmenter(words)
        for b in batches:
            got = {n: pa.array([None if x is None else cutter(x) for x in b.column(n).to_pylist()], pa.list_(pa.string())) for n in fields}
            yield pa.RecordBatch.from_arrays([got.get(n, b.column(n)) for n in b.schema.names], names=b.schema.names)

    return df.mapInArrow(run, schema)


def block_pairs(bed12: DataFrame) -> DataFrame:
    """(bed_id, start, blocks): the blocks of each row, ascending, blockSizes and blockStarts paired by position. Null where a field is null or without a piece, where the two have
    different numbers of pieces, where a piece is no integer, or where a bound
    has more than 64 bits."""
    cut = with_pieces(bed12.select("bed_id", "start", "blockSizes", "blockStarts"), ["blockSizes", "blockStarts"])
    numbers = [F.transform(c, lambda x: F.when(x.rlike(WHOLE), x.try_cast("bigint"))) for c in ("blockSizes", "blockStarts")]
    cut = cut.select("bed_id", "start", numbers[0].alias("_n"), numbers[1].alias("_s"))
    whole = (F.size("_n") > 0) & (F.size("_n") == F.size("_s")) & ~F.exists("_n", lambda x: x.isNull()) & ~F.exists("_s", lambda x: x.isNull())
    first = lambda x: F.try_add(F.col("start"), x["_s"])
    blocks = F.array_sort(F.transform(F.arrays_zip("_s", "_n"), lambda x: F.struct(first(x).alias("start"), F.try_add(first(x), x["_n"]).alias("end"))))
    cut = cut.select("bed_id", "start", F.when(whole, blocks).alias("blocks"))
    return cut.withColumn("blocks", F.when(~F.exists("blocks", lambda x: x["start"].isNull() | x["end"].isNull()), F.col("blocks")))
