"""Problem 6: the whole corpus as token ids of a public byte-level BPE vocabulary.

A text is cut into pieces by the vocabulary's pattern. The pieces of a batch that a task has not met yet are encoded together: pieces of similar length
are the rows of a padded matrix of ids; each round every row merges its leftmost pair of minimum rank, found through a hashed table of pairs, and is
compacted; rows without a pair left drop out. A piece met before is found by its hash and compared by character. The tables (about 1.5 MB, checked) travel from the driver, so executors need no file.

Defined results: a null text and an empty one give the empty list; strings of special tokens are ordinary text; repeated rows give repeated rows.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from spanweave.llm.hashing import Hasher

BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.json"
TABLES_AT_MOST = 64 << 20
#: Pieces that a task remembers, and characters of text that it takes at once.
REMEMBERED, CHUNK = 400_000, 2_000_000
#: Longer pieces are merged through a heap, as rounds over them would cost the square of their length.
LONGEST_ROW = 256
_WIDTHS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 32, 48, 64, 96, 128, 192, LONGEST_ROW)
_BITS, _MULT = 18, np.uint64(0x9E3779B97F4A7C15)
_KNOWN_BITS = 21
_NONE = np.int32(2**31 - 1)

_OTHER, _LETTER, _DIGIT, _SPACE = range(4)
#: Fixed value: white space of the pattern; the Unicode property, which differs from Python's class.
_S = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The endings that the pattern takes as pieces, after an apostrophe that begins a piece.
_ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")


def _kinds() -> np.ndarray:
    """The class of every code point, as the pattern sees it."""
    out = np.full(0x110000, _OTHER, np.uint8)
    for lo, hi in ((0, 0xD800), (0xE000, 0x110000)):
        every = "".join(map(chr, range(lo, hi)))
        for kind, what in ((_LETTER, r"\p{L}+"), (_DIGIT, r"\p{N}+"), (_SPACE, f"[{_S}]+")):
            for m in regex.finditer(what, every):
                out[lo + m.start() : lo + m.end()] = kind
    return out


def piece_starts(codes: np.ndarray, kinds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pieces of the pattern begin in texts laid end to end, which begin at ``first``.

    A piece is an ending such as 's; or letters, digits or other characters, with the space before them; or white space, of which the last character stays
    apart if text follows.
    """
    n = len(codes)
    kind = kinds[codes]
    head = np.zeros(n + 1, bool)
    head[first] = True
    head[n] = True
    space = kind == _SPACE
    start = head[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    blank = codes == 32
    # a space right before text belongs to it
    before = np.zeros(n, bool)
    before[1:] = blank[:-1] & ~space[1:] & ~head[1:n]
    start &= ~before
    # the last white space of a run, if text follows in the same text
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~head[1:n]
    start |= last
    # endings after an apostrophe that begins a piece
    at = np.flatnonzero((codes == 39) & start)
    if len(at):
        pad = np.concatenate([codes, np.zeros(2, codes.dtype)])
        ends = np.concatenate([head, np.ones(2, bool)])
        one, two = np.where(ends[at + 1], 0, pad[at + 1]), np.where(ends[at + 1] | ends[at + 2], 0, pad[at + 2])
        for e in _ENDINGS:
            hit = at[(one == ord(e[0])) & ((two == ord(e[1])) if len(e) > 1 else True)]
            start[hit + 1] = False
            after = hit + 1 + len(e)
            start[after[after < n]] = True
            # a space right after an ending and before text is already a start; nothing else moves
    return np.flatnonzero(start)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable ones for themselves, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_tables(path: str) -> dict[str, np.ndarray]:
    """The ids of the single bytes, and the pairs that merge with rank and result, from a tokenizers JSON file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    ids = model["vocab"]
    single = np.zeros(256, np.int32)
    for letter, byte in _byte_letters().items():
        single[byte] = ids[letter]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    pairs = np.array([[ids[a], ids[b], ids[a + b]] for a, b in merges], np.int64)
    return {"single": single, "pairs": pairs, "kinds": _kinds()}


class Encoder:
    def __init__(self, tables: dict[str, np.ndarray]) -> None:
        self.single, pairs, self.kinds = tables["single"], tables["pairs"], tables["kinds"]
        self.hasher = Hasher()
        size = 1 << _BITS
        self.keys, self.rank, self.into = np.full(size, -1, np.int64), np.full(size, _NONE, np.int32), np.zeros(size, np.int32)
        seen = set()
        for r, (a, b, c) in enumerate(pairs.tolist()):
            key = a << 32 | b
            if key in seen:
                continue
            seen.add(key)
            at = int(self._slot(np.array([key]))[0])
            while self.keys[at] != -1:
                at = (at + 1) & (size - 1)
            self.keys[at], self.rank[at], self.into[at] = key, r, c
        self.forget()

    def forget(self, bits: int = _KNOWN_BITS) -> None:
        self.size, self.bits = 0, bits
        self.hashes, self.place = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.chars, self.char_ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _known(self, hashes: np.ndarray) -> np.ndarray:
        """The store's index of a piece of equal hash, -1 where there is none."""
        mask = (1 << self.bits) - 1
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.place[slot]
        open_ = np.flatnonzero((self.hashes[slot] != hashes) & (out >= 0))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & mask
            got = self.place[slot]
            same = self.hashes[slot] == hashes[open_]
            out[open_] = np.where(same, got, -1)
            go = ~same & (got >= 0)
            open_, slot = open_[go], slot[go]
        return out

    def _remember(self, hashes: np.ndarray) -> None:
        """Give the new pieces, all different, the next indices."""
        mask = (1 << self.bits) - 1
        left = np.arange(len(hashes))
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            free = self.place[slot] < 0
            some, at = left[free], slot[free]
            self.place[at] = self.size + some  # of several that want a slot, one gets it
            won = self.place[at] == self.size + some
            self.hashes[at[won]] = hashes[some[won]]
            lost = np.ones(len(left), bool)
            lost[np.flatnonzero(free)[won]] = False
            left, slot = left[lost], (slot[lost] + 1) & mask
        self.size += len(hashes)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MULT) >> np.uint64(64 - _BITS)).astype(np.int64)

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair; rank _NONE where a pair doesn't merge."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        slot = self._slot(keys)
        seen = self.keys[slot]
        while True:
            open_ = np.flatnonzero((seen != keys) & (seen != -1) & (keys != -2))
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << _BITS) - 1)
            seen[open_] = self.keys[slot[open_]]
        hit = seen == keys
        return np.where(hit, self.rank[slot], _NONE), self.into[slot]

    def _matrix(self, ids: np.ndarray) -> list[np.ndarray]:
        """Rows of ids padded with -1, merged; a list of rows' ids."""
        n, width = ids.shape
        rank, into = (x.reshape(n, width - 1) for x in self._find(ids[:, :-1].ravel(), ids[:, 1:].ravel()))
        out = np.full((n, width), -1, np.int32)
        live = np.arange(n)
        cols = np.arange(width)
        while len(live):
            at = rank.argmin(1)  # leftmost of the minimum
            rows = np.arange(len(live))
            go = rank[rows, at] != _NONE
            if not go.all():
                done = ~go
                out[live[done], : ids.shape[1]] = ids[done]
                live, ids, rank, into, at = live[go], ids[go], rank[go], into[go], at[go]
                rows = rows[: len(live)]
                if not len(live):
                    break
            ids[rows, at] = into[rows, at]
            width = ids.shape[1]
            if width == 2:
                out[live, 0] = ids[:, 0]
                break
            # compaction: close the gap right of the merged place
            pick = cols[: width - 1] + (cols[: width - 1] > at[:, None])
            ids = np.take_along_axis(ids, pick, 1)
            pick = pick[:, : width - 2]
            rank, into = np.take_along_axis(rank, pick, 1), np.take_along_axis(into, pick, 1)
            for side in (-1, 0):  # the pairs left and right of the merged place are new
                j = at + side
                ok = np.flatnonzero((j >= 0) & (j < width - 2))
                jj = j[ok]
                rank[ok, jj], into[ok, jj] = self._find(ids[ok, jj], ids[ok, jj + 1])
        return out

    def _heap(self, ids: list[int]) -> list[int]:
        n = len(ids)
        a = np.array(ids)
        rank, into = self._find(a[:-1], a[1:])
        heap = [(r, i, ids[i], ids[i + 1], c) for i, (r, c) in enumerate(zip(rank.tolist(), into.tolist())) if r != _NONE]
        heapq.heapify(heap)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        cache: dict[tuple[int, int], tuple[int, int]] = {}
        while heap:
            _, i, x, y, c = heapq.heappop(heap)
            j = right[i]
            if ids[i] != x or j < 0 or ids[j] != y:
                continue
            ids[i], ids[j] = c, -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for p, q in ((left[i], i), (i, right[i])):
                if p >= 0 and q >= 0:
                    pair = (ids[p], ids[q])
                    if pair not in cache:
                        r, t = self._find(np.array([pair[0]]), np.array([pair[1]]))
                        cache[pair] = int(r[0]), int(t[0])
                    r, t = cache[pair]
                    if r != _NONE:
                        heapq.heappush(heap, (r, p, *pair, t))
        return [x for x in ids if x >= 0]

    def _learn(self, raw: list[bytes]) -> None:
        """Encode new pieces and append them to the store."""
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        at = np.r_[0, np.cumsum(size)]
        ids = self.single[np.frombuffer(b"".join(raw), np.uint8)]
        count = np.ones(len(raw), np.int64)
        got: list[tuple[np.ndarray, np.ndarray]] = []  # rows, matrix padded with -1
        low = 0
        one = np.flatnonzero(size == 1)
        got.append((one, ids[at[one]][:, None]))
        low = 1
        for width in _WIDTHS:
            rows = np.flatnonzero((size > low) & (size <= width))
            low = width
            for s in range(0, len(rows), 65536):
                some = rows[s : s + 65536]
                place = at[some][:, None] + np.arange(width)
                inside = np.arange(width) < size[some][:, None]
                m = np.where(inside, ids[np.minimum(place, len(ids) - 1)], -1).astype(np.int32)
                m = self._matrix(m)
                count[some] = (m >= 0).sum(1)
                got.append((some, m))
        for r in np.flatnonzero(size > LONGEST_ROW):
            m = np.array(self._heap(ids[at[r] : at[r + 1]].tolist()), np.int32)[None]
            count[r] = m.shape[1]
            got.append((np.array([r]), m))
        ends = np.cumsum(count)
        flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
        for rows, m in got:
            if len(rows):
                inside = m >= 0
                place = (ends[rows] - count[rows])[:, None] + np.arange(m.shape[1])
                flat[place[inside]] = m[inside]
        self.ends = np.concatenate([self.ends, self.ends[-1] + ends])
        self.flat = np.concatenate([self.flat, flat])

    def _store(self, full: str, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Append pieces of a text to the store, their characters and their ids."""
        size = ends - starts
        upto = np.cumsum(size)
        place = np.arange(upto[-1] if len(upto) else 0) + np.repeat(starts - (upto - size), size)
        self.chars = np.concatenate([self.chars, codes[place]])
        self.char_ends = np.concatenate([self.char_ends, self.char_ends[-1] + upto])
        self._learn([full[a:b].encode() for a, b in zip(starts.tolist(), ends.tolist())])

    def _same(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Whether each piece has the characters of the stored one; the pieces lie end to end."""
        size = ends - starts
        begin = self.char_ends[index]
        fits = self.char_ends[index + 1] - begin == size
        if not len(index):
            return fits
        place = np.arange(len(codes)) + np.repeat(np.where(fits, begin - starts, -starts), size)
        equal = self.chars[np.minimum(place, len(self.chars) - 1)] == codes
        return fits & np.logical_and.reduceat(equal, starts)

    def batch(self, texts: list[str | None]) -> pa.ListArray:
        """The ids of each text."""
        if self.size > REMEMBERED:
            self.forget()  # the table is bounded
        full = "".join(t for t in texts if t)
        chars = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
        codes = np.frombuffer(full.encode("utf-32-le"), np.uint32)
        n = len(codes)
        doc_ends = np.cumsum(chars)
        starts = piece_starts(codes, self.kinds, (doc_ends - chars)[chars > 0]) if n else np.zeros(0, np.int64)
        if self.size + len(starts) > 1 << (self.bits - 1):  # one very long text
            self.forget(max(_KNOWN_BITS, 1 + len(starts).bit_length()))
        self.hasher.take(codes)
        ends = np.append(starts[1:], n)
        hashes = self.hasher.of(starts, ends)
        index = self._known(hashes)
        new = np.flatnonzero(index < 0)
        for s in range(0, len(new), REMEMBERED):
            some = new[s : s + REMEMBERED]
            some = some[self._known(hashes[some]) < 0]
            fresh, where = np.unique(hashes[some], return_index=True)
            where = some[where]
            self._store(full, codes, starts[where], ends[where])
            self._remember(fresh)
        index[new] = self._known(hashes[new])
        wrong = np.flatnonzero(~self._same(codes, starts, ends, index))
        if len(wrong):  # other characters of equal hash: encoded each for itself
            self._store(full, codes, starts[wrong], ends[wrong])
            index[wrong] = self.size + np.arange(len(wrong))
            self.size += len(wrong)
        counts = np.diff(np.searchsorted(starts, np.r_[0, doc_ends]))
        flat, ends = self.flat, self.ends
        start = ends[index]
        size = ends[index + 1] - start if len(index) else start
        upto = np.r_[0, np.cumsum(size)]
        place = np.arange(upto[-1]) + np.repeat(start - upto[:-1], size)
        doc_ends = upto[np.r_[0, np.cumsum(counts)]]
        return pa.ListArray.from_arrays(pa.array(doc_ends.astype(np.int32)), pa.array(flat[place]))


def encode_texts(df: DataFrame, key: str, text: str, path: str = BYTE_BPE_50K) -> DataFrame:
    """(key, ids) of each row: the token ids of ``text`` by the vocabulary file ``path``, which only the driver reads."""
    tables = load_tables(path)
    size = sum(x.nbytes for x in tables.values())
    if size > TABLES_AT_MOST:
        raise ValueError(f"the vocabulary takes {size} bytes; {TABLES_AT_MOST} may be sent to the tasks")
    sent = df.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            s = 0
            while s < len(texts):
                e, chars = s, 0
                while e < len(texts) and (e == s or chars + len(texts[e] or "") <= CHUNK):
                    chars += len(texts[e] or "")
                    e += 1
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), encoder.batch(texts[s:e])], names=[key, "ids"])
                s = e

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>")
