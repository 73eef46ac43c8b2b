"""Problem 7: passages of held-out test items in a corpus of messages.

The items' normalised runs of ``n`` words form a hash set that is built once and broadcast (the size of the items is checked first). Every text of every
message is scanned by windows of ``n`` words: windows whose words are all known to the set are looked up, and a hit is verified, as the set holds the
words themselves. Items too large to broadcast stay distributed: the runs of items and messages meet in one join on BLAKE2b digests of 128 bits, after one scan
of the corpus, runs that hold a large share of all rows by broadcast.

Defined results: null and empty texts hold nothing; items that are null or shorter than ``n`` words leak nowhere; windows do not reach
from one part of a message into another; a pair comes out once a message, however often the message holds the passage; repeated messages come out each
(where items are too large to broadcast, once for each key).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanweave.llm.mail import readable
from spanweave.runtime import cut, hot_join, hot_keys

N = 12
#: Characters of items whose runs are broadcast; about 40 bytes of set each.
BROADCAST_CHARS = 4_000_000
words_of = re.compile(r"[a-z0-9]+").findall
_word = re.compile(r"[a-z0-9]+")
Grams = dict[tuple[str, ...], tuple[int, ...]]


def _runs(items: list[tuple[int, str]], n: int) -> tuple[Grams, frozenset[str]]:
    grams: Grams = {}
    for key, text in items:
        words = words_of(text.lower())
        for i in range(len(words) - n + 1):
            g = tuple(words[i : i + n])
            if key not in (old := grams.get(g, ())):
                grams[g] = (*old, key)
    return grams, frozenset(w for g in grams for w in g)


def _hits(words: list[str], grams: Grams, known: frozenset[str], n: int) -> Iterator[tuple[int, tuple[int, ...]]]:
    """Places of the windows that items hold, and these items."""
    marks = bytes(map(known.__contains__, words))
    full = b"\1" * n
    at = marks.find(full)
    while at >= 0:
        hit = grams.get(tuple(words[at : at + n]))
        if hit:
            yield at, hit
        at = marks.find(full, at + 1)


def leaked_items(text: str, grams: Grams, known: frozenset[str], n: int = N) -> set[int]:
    return {i for part in readable(text) for _, hit in _hits(words_of(part.lower()), grams, known, n) for i in hit}


def cleaned(part: str, grams: Grams, known: frozenset[str], n: int = N) -> tuple[str, list[int]]:
    """A readable text without the passages that items hold, and these items in order."""
    found: set[int] = set()
    while True:  # what is left of two sides may be a passage again
        low = part.lower()
        if len(low) != len(part):  # letters whose small form is longer
            low = "".join(c.lower()[0] for c in part)
        places = [m.span() for m in _word.finditer(low)]
        out, end = [], 0
        for at, hit in _hits([low[a:b] for a, b in places], grams, known, n):
            found.update(hit)
            out.append(part[end : max(end, places[at][0])])
            end = places[at + n - 1][1]
        if not end:
            return part, sorted(found)
        part = "".join([*out, part[end:]])


def _given(items: DataFrame, item: str) -> DataFrame:
    return items.select(F.col(item).cast("bigint").alias("i"), F.col("text").alias("t")).where("i IS NOT NULL AND t IS NOT NULL")


def _set(given: DataFrame, n: int) -> tuple[Grams, frozenset[str]] | None:
    """The hash set of the items' runs, None where they are too large to broadcast."""
    if given.agg(F.coalesce(F.sum(F.length("t") + 8), F.lit(0))).first()[0] > BROADCAST_CHARS:
        return None
    return _runs([(r.i, r.t) for r in given.collect()], n)  # checked just before


def _digests(words: list[str], n: int) -> set[bytes]:
    return {blake2b(" ".join(words[i : i + n]).encode(), digest_size=16).digest() for i in range(len(words) - n + 1)}


def _windows(df: DataFrame, schema: str, n: int, parts) -> DataFrame:
    """(key, c, d): the digest of each different window of ``n`` words in the texts of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k", "c", "d"]
        for b in batches:
            rows: list[int] = []
            raw: list[bytes] = []
            for r, t in enumerate(b.column(1).to_pylist()):
                got = set().union(*[_digests(words_of(p.lower()), n) for p in parts(t)]) if t else set()
                rows += [r] * len(got)
                raw += got
                if len(rows) > 500_000 or r == len(b) - 1:
                    two = np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *[pa.array(np.ascontiguousarray(two[:, i])) for i in (0, 1)]], names=names)
                    rows, raw = [], []

    return df.mapInArrow(run, schema)


def _joined(docs: DataFrame, given: DataFrame, key: str, text: str, item: str, n: int) -> DataFrame:
    keys = ["c", "d"]
    kind = docs.schema[key].dataType.simpleString()
    runs = _windows(given, "k bigint, c bigint, d bigint", n, lambda t: [t]).groupBy(*keys).agg(F.collect_set("k").alias("items"))  # the items that share a run
    runs = cut(runs)
    seen = cut(_windows(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), f"k {kind}, c bigint, d bigint", n, readable))
    hot = hot_keys(seen.groupBy(*keys).agg(F.count("*").alias("rows")), keys, "rows", seen)
    pairs = hot_join(seen, runs, keys, hot).select(F.col("k").alias(key), F.explode("items").alias(item))
    return pairs.distinct()


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", n: int = N) -> DataFrame:
    """(key, item): each pair where a text of the message holds at least ``n`` consecutive words of the item."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField(item, T.LongType())])
    given = _given(items, item)
    built = _set(given, n)
    if built is None:
        return _joined(docs, given, key, text, item, n)
    sent = docs.sparkSession.sparkContext.broadcast(built)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, known = sent.value
        for b in batches:
            rows, got = [], []
            for r, t in enumerate(b.column(1).to_pylist()):
                for i in sorted(leaked_items(t, grams, known, n)) if t else ():
                    rows.append(r)
                    got.append(i)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(got, pa.int64())], names=[key, item])

    return docs.select(key, text).mapInArrow(run, schema)


def without_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id") -> DataFrame:
    """The messages that hold no passage of any item."""
    return docs.join(find_leaks(docs, items, key).select(key).distinct(), key, "left_anti")


def without_passages(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", n: int = N) -> DataFrame:
    """(key, part, text, items): every readable text of every message, numbered from 0, without the passages that items hold; ``items`` are those that were cut out.

    Null and empty messages have no texts. The items must be small enough to broadcast, otherwise an error says so.
    """
    built = _set(_given(items, item), n)
    if built is None:
        raise ValueError(f"the items hold more than {BROADCAST_CHARS} characters; remove whole messages with without_leaks")
    sent = docs.sparkSession.sparkContext.broadcast(built)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, known = sent.value
        for b in batches:
            rows, got = [], []
            for r, t in enumerate(b.column(1).to_pylist()):
                for i, p in enumerate(readable(t) if t else ()):
                    rows.append(r)
                    got.append((i, *cleaned(p, grams, known, n)))
            part, clean, cut_out = zip(*got) if got else ((), (), ())
            cols = [pa.array(part, pa.int32()), pa.array(clean, pa.string()), pa.array(cut_out, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *cols], names=[key, "part", "text", "items"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, part int, text string, items array<bigint>")
