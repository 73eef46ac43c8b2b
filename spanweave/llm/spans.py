"""Problem 8: long exact spans that records share with other records, by relative parsing against indexed reference blocks.

Every text is cut into blocks: a window of ``length`` characters names its anchor, the place of the smallest hash of ``GRAM`` characters in it (the first of
equals), and the windows of one anchor occurrence form a block. The same window has the same anchor wherever it stands, so a factor of ``length``
characters or more can only lie in blocks of one anchor: a text needs to be factored against these reference blocks alone, and nothing is lost against
factoring it against every block of the corpus. That is what keeps the cost in proportion to the corpus.

Factoring: a block that stands whole in another record is a factor. Any other block is parsed greedily from its first window on: the index of the reference
blocks (windows of the same anchor by offset and hash) gives a window of another record, the match is followed to the right character by character, and the
longer of two candidates is the factor. Each parse goes on at the boundary, with the first window that the factor does not hold, until no window
is left. A candidate whose characters differ is no factor; then every reference block that holds the hash is compared.

A block is a row of some fifty bytes, equal blocks meet as one class (pre-aggregated before they move), and only one text of each class that needs parsing is
read. Up to ``TOGETHER`` classes of an anchor are parsed inside one task; beyond that their windows are rows of a distributed aggregation. No pairs
are formed anywhere. Classes (and those windows) are equal if their BLAKE2b digests of 128 bits are; all else is compared by character.

Defined results: null, empty and short texts share nothing; copies of a text share all of it; a span repeated within one record only is not shared; key
values are expected to be unique and not null (rows with a null key are left out); characters are Unicode code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanweave.llm.hashing import Hasher, mix
from spanweave.runtime import cut, hot_join, hot_keys

LENGTH, GRAM = 300, 96
TOGETHER = 4096
#: Characters hashed at once, and windows of one text that are taken together (longer texts go in pieces that overlap).
CHUNK, PIECE = 1 << 20, 1 << 22
_PLACE = np.uint64((1 << 24) - 1)
_ROWS = 4096
_CLASS = ["h", "c", "d", "before", "after"]
_KEYS = "h bigint, c bigint, d bigint, before int, after int"


def _window_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` neighbours."""
    n = len(v)
    pad = -n % w
    x = np.concatenate([v, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, w)
    fore = np.minimum.accumulate(x, 1).ravel()
    back = np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], fore[w - 1 : n])


def _digests(pieces: Iterator[str]) -> np.ndarray:
    """Two 64-bit halves of the digest of each piece."""
    raw = b"".join([blake2b(p.encode("utf-8", "surrogatepass"), digest_size=16).digest() for p in pieces])
    return np.frombuffer(raw, np.int64).reshape(-1, 2)


def blocks_of(hasher: Hasher, texts: list[str], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For each block: text, anchor hash, digest of its characters, anchor's place, characters from the first and from the last window start to the anchor."""
    codes = [_codes(t) for t in texts]
    size = np.array([len(t) for t in codes])
    ends = np.cumsum(size)
    hasher.take(np.concatenate(codes))
    grams = hasher.all(gram)
    value = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    least = _window_min(value, length - gram + 1)
    inside = np.zeros(len(least) + 1, np.int32)
    starts = ends - size
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends - length + 1, -1)
    p = np.flatnonzero(np.cumsum(inside)[:-1])
    m = (least[p] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (p[1:] != p[:-1] + 1)])
    last = np.r_[first[1:], len(p)] - 1
    lo, hi, at = p[first], p[last], m[first]
    text = np.searchsorted(ends, lo, "right")
    from_, to = (lo - starts[text]).tolist(), (hi + length - starts[text]).tolist()
    digest = _digests(texts[t][a:b] for t, a, b in zip(text.tolist(), from_, to))
    return text, grams[at].view(np.int64), digest, at - starts[text], at - lo, at - hi


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _index(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """A row per block: doc, h, c, d, at, before, after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            held: list[tuple[int, int, str]] = []  # row, offset, characters
            size = 0

            def out() -> pa.RecordBatch:
                text, h, digest, at, before, after = blocks_of(hasher, [x for _, _, x in held], length, gram)
                rows = np.array([r for r, _, _ in held])[text]
                at = at + np.array([o for _, o, _ in held])[text]
                held.clear()
                ints = [pa.array(x.astype(np.int32)) for x in (at, before, after)]
                cols = [b.column(0).take(pa.array(rows)), pa.array(h), *[pa.array(np.ascontiguousarray(digest[:, i])) for i in (0, 1)], *ints]
                return pa.RecordBatch.from_arrays(cols, names=["doc", "h", "c", "d", "at", "before", "after"])

            for r, t in enumerate(b.column(1).to_pylist()):
                for o in range(0, len(t) - length + 1, PIECE):
                    part = t[o : o + PIECE + length - 1]
                    if size and size + len(part) > CHUNK:
                        yield out()
                        size = 0
                    held.append((r, o, part))
                    size += len(part)
            if held:
                yield out()

    return docs.mapInArrow(run, "doc bigint, h bigint, c bigint, d bigint, at int, before int, after int")


def _common(codes: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many characters agree from places ``a`` and ``b`` on, ``most`` at the most."""
    out = np.zeros(len(a), np.int64)
    for s in range(0, len(a), _ROWS):
        x, y, m = a[s : s + _ROWS, None], b[s : s + _ROWS, None], most[s : s + _ROWS]
        k = np.arange(int(m.max()) + 1)
        differ = codes[np.minimum(x + k, len(codes) - 1)] != codes[np.minimum(y + k, len(codes) - 1)]
        differ |= k >= m[:, None]
        out[s : s + _ROWS] = differ.argmax(1)
    return out


def factors(hasher: Hasher, group: np.ndarray, doc: np.ndarray, several: np.ndarray, before: np.ndarray, texts: list[str], length: int) -> tuple[np.ndarray, ...]:
    """The factors of the blocks that lie in one record each, parsed against the blocks of their ``group`` (anchor).

    ``before`` are the characters from a block's start to its anchor. Result: block, start and length of each factor, block by block.
    """
    parts = [_codes(t) for t in texts]
    codes = np.concatenate(parts)
    size = np.array([len(x) for x in parts])
    ends = np.cumsum(size)
    begin = ends - size
    wide = size - length + 1  # windows of each block
    w_end = np.cumsum(wide)
    who = np.repeat(np.arange(len(texts)), wide)
    place = np.arange(w_end[-1]) + np.repeat(begin - (w_end - wide), wide)
    hasher.take(codes)
    slot = group.astype(np.uint64)[who] << np.uint64(20) | (before[who] - place + begin[who]).astype(np.uint64)  # anchor and offset
    key = mix(hasher.all(length)[place] + mix(slot))
    owner = np.where(several, 0, np.unique(doc, return_inverse=True)[1] + 1)[who]
    order = np.lexsort((owner, key))
    sorted_key = key[order]
    head = np.flatnonzero(np.r_[True, sorted_key[1:] != sorted_key[:-1]])
    tail = np.r_[head[1:], len(order)] - 1
    of = np.empty(len(order), np.int64)  # the group of equal keys of each window
    of[order] = np.repeat(np.arange(len(head)), tail - head + 1)
    pair = np.stack([order[head][of], order[tail][of]])  # a window of the first and of the last record
    other = owner[pair] != owner
    some = other.any(0) & (owner > 0)
    after = np.where(some, np.arange(len(some)), len(some))
    after = np.r_[np.minimum.accumulate(after[::-1])[::-1], len(some)]  # the next window with a candidate

    def seek(block: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = after[w]
        go = w < w_end[block]
        return block[go], w[go]

    found: list[tuple[np.ndarray, ...]] = []
    block, w = seek(np.flatnonzero(~several), (w_end - wide)[~several])
    while len(w):
        best = np.zeros(len(w), np.int64)
        for side in (0, 1):
            ok = np.flatnonzero(other[side, w])
            a, b = w[ok], pair[side, w[ok]]
            most = np.minimum(ends[who[a]] - place[a], ends[who[b]] - place[b])
            best[ok] = np.maximum(best[ok], _common(codes, place[a], place[b], most))
        for i in np.flatnonzero(best < length):  # equal hashes of unequal windows: look at every window of the group
            rest = order[head[of[w[i]]] : tail[of[w[i]]] + 1]
            rest = rest[owner[rest] != owner[w[i]]]
            best[i] = max((int(_common(codes, place[w[i : i + 1]], place[q : q + 1], np.array([length]))[0]) for q in rest.tolist()), default=0)
        hit = best >= length
        found.append((block[hit], (place[w] - begin[block])[hit], best[hit]))
        block, w = seek(block, w + np.where(hit, best - length, 0) + 1)
    if not found:
        return (np.zeros(0, np.int64),) * 3
    cols = [np.concatenate(x) for x in zip(*found)]
    by_block = np.lexsort((cols[1], cols[0]))
    return tuple(x[by_block] for x in cols)


def _spans(offsets: list[int], length: int) -> list[tuple[int, int]]:
    """Runs of window offsets (characters before the anchor) as stretches relative to the anchor, overlapping ones joined."""
    out: list[tuple[int, int]] = []
    for o in sorted(offsets, reverse=True):
        s, e = -o, length - o
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


_ANSWER = f"{_KEYS}, spans array<struct<s:int,e:int>>"


def _parsed(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The factors of blocks that come sorted by anchor, as spans relative to it."""
    hasher = Hasher()
    held: list[pa.RecordBatch] = []
    size = 0

    def out(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        h, doc, several, before = (t.column(c).to_numpy() for c in ("h", "doc", "several", "before"))
        group = np.cumsum(np.r_[0, h[1:] != h[:-1]])
        block, start, long = factors(hasher, group, doc, several, before.astype(np.int64), t.column("text").to_pylist(), length)
        rows, count = np.unique(block, return_counts=True)
        s = (start - before[block]).astype(np.int32)
        spans = pa.StructArray.from_arrays([pa.array(s), pa.array(s + long.astype(np.int32))], ["s", "e"])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)].astype(np.int32)), spans)
        keys = t.select(_CLASS).take(pa.array(rows)).combine_chunks()
        return pa.RecordBatch.from_arrays([*[c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in keys.columns], lists], names=[*_CLASS, "spans"])

    for b in batches:
        held.append(b)
        size += b.column("text").nbytes
        if size > CHUNK:  # all but the last anchor, which may go on
            t = pa.Table.from_batches(held)
            h = t.column("h").to_numpy()
            done = int(np.searchsorted(h, h[-1], "left"))
            if done:
                yield out(t.slice(0, done))
            held, size = t.slice(done).to_batches(), 0
    if t := sum(map(len, held)):
        yield out(pa.Table.from_batches(held))


def _boundaries(classes: DataFrame, length: int) -> DataFrame:
    """The class key and spans of the classes that share an anchor; rows carry doc, several, n (classes of the anchor) and text."""
    cols = [*_CLASS, "doc", "several", "text"]
    few = classes.where(F.col("n") <= TOGETHER).select(*cols).repartition("h").sortWithinPartitions("h").mapInArrow(lambda b: _parsed(b, length), _ANSWER)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            if texts:
                wide = np.array([len(t) - length + 1 for t in texts])
                rows = np.repeat(np.arange(len(b)), wide)
                place = np.arange(len(rows)) - np.repeat(np.cumsum(wide) - wide, wide)
                off = (b.column("before").to_numpy()[rows] - place).astype(np.int32)
                w = _digests(texts[r][i : i + length] for r, i in zip(rows.tolist(), place.tolist()))
                take = b.select([*_CLASS, "doc", "several"]).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*take.columns, pa.array(off), *[pa.array(np.ascontiguousarray(w[:, i])) for i in (0, 1)]], names=[*_CLASS, "doc", "several", "off", "w", "x"])

    many = classes.where(F.col("n") > TOGETHER).select(*cols).mapInArrow(each, f"{_KEYS}, doc bigint, several boolean, off int, w bigint, x bigint")
    key = ["h", "off", "w", "x"]
    counted = many.groupBy(*key).agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.bool_or("several").alias("s"), F.count("*").alias("rows"))
    shared = counted.where("s OR a < b")
    back = hot_join(many.where("NOT several"), shared.select(*key), key, hot_keys(shared, key, "rows", many)).groupBy(*_CLASS).agg(F.array_sort(F.collect_list("off")).alias("offs"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
        for b in batches:
            spans = pa.array([[{"s": s, "e": e} for s, e in _spans(o, length)] for o in b.column(5).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], spans], names=[*_CLASS, "spans"])

    return few.unionByName(back.mapInArrow(runs, _ANSWER))


def shared_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(key, span_start, span_end): maximal stretches whose characters all lie in windows of ``length`` characters that stand verbatim in another record."""
    texts = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")).where(F.col(key).isNotNull() & (F.length(text) >= length))
    index = cut(_index(texts, length, gram))
    anchors = index.groupBy("h").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.count("*").alias("rows")).where("a < b")
    anchors = cut(anchors.select("h", "rows"))
    found = cut(hot_join(index, anchors.select("h"), ["h"], hot_keys(anchors, ["h"], "rows", index)))  # blocks whose anchor stands in several records
    classes = cut(found.groupBy(*_CLASS).agg(F.min(F.struct("doc", "at")).alias("one"), (F.min("doc") < F.max("doc")).alias("several"), F.count("*").alias("rows")))
    whole = classes.where("several").select(*_CLASS, F.array(F.struct((-F.col("before")).alias("s"), (F.lit(length) - F.col("after")).alias("e"))).alias("spans"))
    edges_of = cut(classes.groupBy("h").agg(F.count("*").alias("n"), F.bool_and("several").alias("known")).where("n > 1 AND NOT known").select("h", "n"))
    rest = hot_join(classes, edges_of, ["h"], hot_keys(edges_of, ["h"], "n", classes)).select(*_CLASS, "n", "several", F.col("one.doc").alias("doc"), F.col("one.at").alias("at"))
    read = F.substring(F.col("text"), F.col("at") - F.col("before") + 1, F.col("before") - F.col("after") + length)
    edges = cut(rest.join(texts, "doc").select(*_CLASS, "n", "several", "doc", read.alias("text")))
    answers = cut(whole.unionByName(_boundaries(edges, length)))
    spans = hot_join(found, answers, _CLASS, hot_keys(classes, _CLASS, "rows", found))
    spans = spans.select("doc", "at", F.explode("spans").alias("x")).select("doc", (F.col("at") + F.col("x.s")).alias("s"), (F.col("at") + F.col("x.e")).alias("e"))
    order = Window.partitionBy("doc").orderBy("s", "e")  # the spans of one text
    reach = spans.withColumn("reach", F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    runs = reach.withColumn("run", F.sum(F.when(F.col("reach").isNull() | (F.col("s") > F.col("reach")), 1).otherwise(0)).over(order))
    merged = runs.groupBy("doc", "run").agg(F.min("s").cast("bigint").alias("span_start"), F.max("e").cast("bigint").alias("span_end"))
    return merged.select(F.col("doc").alias(key), "span_start", "span_end")


def shared_share(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, n_chars, n_shared, share) of every record: how much of it stands elsewhere; null texts have no characters and share 0."""
    spans = shared_spans(docs, key, text, length).groupBy(key).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("n_shared"))
    n = F.coalesce(F.length(text), F.lit(0)).cast("bigint")
    out = docs.select(key, n.alias("n_chars")).join(spans, key, "left").withColumn("n_shared", F.coalesce("n_shared", F.lit(0).cast("bigint")))
    return out.withColumn("share", F.when(F.col("n_chars") > 0, F.col("n_shared") / F.col("n_chars")).otherwise(F.lit(0.0)))
