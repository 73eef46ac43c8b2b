"""Binary sources: BAM (S19, K9) and bigWig (S25) as Python data sources. Paths may be local or of any file system that Arrow knows (hdfs, s3, ...).

``spark.dataSource.register(BamSource)``, then ``spark.read.format("spanweave_bam").load(path)``; ``spanweave_bigwig`` likewise. A BAM file is one partition per file (its records have no
split marks without an index); a bigWig file is one partition per leaf group of its index.
"""

from __future__ import annotations

import dataclasses
import fnmatch
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

_SEQ = "=ACMGRSVTWYHKDBN"
_CIGAR = "MIDNSHP=X"
_OPERATION = re.compile(r"(\d+)([MIDNSHP=X])")
_WRITTEN = ("qname", "flag", "rname", "pos", "mapq", "cigar", "seq", "qual")
_BLOCK = 60_000


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        path = os.path.abspath(path)
    return fs.FileSystem.from_uri(path.replace("file:///", "/", 1) if path.startswith("file:///") else path.removeprefix("file:"))


def _open(path: str):
    where, at = _place(path)
    return where.open_input_file(at)


def _files(path: str) -> list[str]:
    """The files of a folder, or those that a last part with ``*`` or ``?`` matches, or the file itself."""
    where, at = _place(path)
    scheme = path.partition("://")[0] + "://" if "://" in path and not path.startswith("file:") else ""
    folder, _, last = at.rpartition("/")
    if any(c in last for c in "*?"):
        found = [f.path for f in where.get_file_info(fs.FileSelector(folder)) if fnmatch.fnmatch(f.base_name, last)]
    elif where.get_file_info(at).type == fs.FileType.Directory:
        found = [f.path for f in where.get_file_info(fs.FileSelector(at)) if f.is_file and not f.base_name.startswith(("_", "."))]
    else:
        found = [at]
    return sorted(scheme + p for p in found)


class _BgzfReader:
    """Bytes of a file of concatenated gzip members."""

    def __init__(self, path: str) -> None:
        self.file, self.rest, self.inflate = _open(path), b"", zlib.decompressobj(31)
        self.raw = b""

    def read(self, n: int) -> bytes:
        while len(self.rest) < n:
            if not self.raw:
                self.raw = self.file.read(1 << 16)
                if not self.raw:
                    break
            self.rest += self.inflate.decompress(self.raw)
            self.raw = self.inflate.unused_data
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            else:
                self.raw = b""
        out, self.rest = self.rest[:n], self.rest[n:]
        return out

    def close(self) -> None:
        self.file.close()


def read_bam(path: str) -> Iterator[tuple]:
    """_pos, qname, flag, rname, pos (0-based), mapq, cigar, seq, qual of each record."""
    f = _BgzfReader(path)
    try:
        if f.read(4) != b"BAM\1":
            raise ValueError(f"{path} is no BAM file")
        f.read(struct.unpack("<i", f.read(4))[0])
        refs = []
        for _ in range(struct.unpack("<i", f.read(4))[0]):
            refs.append(f.read(struct.unpack("<i", f.read(4))[0])[:-1].decode())
            f.read(4)
        at = 0
        while len(head := f.read(4)) == 4:
            b = f.read(struct.unpack("<i", head)[0])
            ref, pos, name, mapq, _, ops, flag, size = struct.unpack_from("<iiBBHHHi", b)
            o = 32
            qname = b[o : o + name - 1].decode()
            o += name
            cigar = "".join(f"{x >> 4}{_CIGAR[x & 15]}" for x in struct.unpack_from(f"<{ops}I", b, o)) or "*"
            o += 4 * ops
            packed = b[o : o + (size + 1) // 2]
            seq = "".join(_SEQ[x >> 4] + _SEQ[x & 15] for x in packed)[:size] or "*"
            o += (size + 1) // 2
            qual = b[o : o + size]
            text = "*" if not size or qual[0] == 255 else bytes(q + 33 for q in qual).decode()
            yield at, qname, flag, refs[ref] if ref >= 0 else None, pos, mapq, cigar, seq, text
            at += 1
    finally:
        f.close()


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "spanweave_bam"

    def schema(self) -> str:
        return "_pos bigint, qname string, flag int, rname string, pos bigint, mapq int, cigar string, seq string, qual string"

    def reader(self, schema) -> DataSourceReader:
        return _FileReader(self.options["path"], read_bam)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _BamWriter(self.options["path"], [tuple(x) for x in json.loads(self.options["refs"])])


class _FileReader(DataSourceReader):
    def __init__(self, path: str, read) -> None:
        self.path, self.how = path, read

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in _files(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.how(partition.value)


def _record(ids: dict[str, int], r: tuple) -> bytes:
    """A record (qname, flag, rname, pos, mapq, cigar, seq, qual) with its size ahead."""
    qname, flag, rname, pos, mapq, cigar, seq, qual = r
    ops = [int(n) << 4 | _CIGAR.index(c) for n, c in _OPERATION.findall(cigar or "*")]
    letters = "" if seq in (None, "*") else seq
    codes = [_SEQ.index(c) for c in letters] + [0] * (len(letters) % 2)
    packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2))
    q = b"\xff" * len(letters) if qual in (None, "*") else bytes(ord(c) - 33 for c in qual)
    body = struct.pack("<iiBBHHHiiii", ids.get(rname, -1), pos, len(qname) + 1, mapq, 4680, len(ops), flag, len(letters), -1, -1, 0)
    body += qname.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + packed + q
    return struct.pack("<i", len(body)) + body


def _write_blocks(f, parts: Iterator[bytes]) -> None:
    """Parts as blocks of the format, one by one; the end mark after them."""

    def put(block: bytes) -> None:
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        data = z.compress(block) + z.flush()
        f.write(b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(data) + 25) + data + struct.pack("<II", zlib.crc32(block), len(block)))

    held = b""
    for p in parts:
        if held and len(held) + len(p) > _BLOCK:
            put(held)
            held = b""
        held += p
        while len(held) > _BLOCK:
            put(held[:_BLOCK])
            held = held[_BLOCK:]
    if held:
        put(held)
    f.write(bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000"))


def bam_parts(refs: list[tuple[str, int]], records: Iterator[tuple]) -> Iterator[bytes]:
    text = "".join(f"@SQ\tSN:{n}\tLN:{k}\n" for n, k in refs).encode()
    head = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(refs))
    yield head + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k) for n, k in refs)
    ids = {n: i for i, (n, _) in enumerate(refs)}
    for r in records:
        yield _record(ids, r)


class _BamWriter(DataSourceWriter):
    """A file per task, named by an id of its own; files of failed tasks and jobs are removed."""

    def __init__(self, path: str, refs: list[tuple[str, int]]) -> None:
        self.path, self.refs = path, refs

    def write(self, iterator) -> WriterCommitMessage:
        where, at = _place(self.path)
        where.create_dir(at, recursive=True)
        name = f"{at}/part-{uuid.uuid4().hex}.bam"
        with where.open_output_stream(name) as f:
            _write_blocks(f, bam_parts(self.refs, (tuple(r[c] for c in _WRITTEN) for r in iterator)))
        return _Written(name)

    def abort(self, messages) -> None:
        where, _ = _place(self.path)
        for m in messages:
            if m is not None:
                where.delete_file(m.name)


@dataclasses.dataclass
class _Written(WriterCommitMessage):
    name: str


def write_bam(df: DataFrame, path: str, refs: list[tuple[str, int]]) -> None:
    """K9: alignments (qname, flag, rname, pos, mapq, cigar, seq, qual) as a folder of BAM files, one per task, in the frame's order; ``refs`` are the references with their lengths."""
    register(df.sparkSession)
    df.select(*_WRITTEN).write.format("spanweave_bam").option("refs", json.dumps(refs)).mode("append").save(path)


# ---- bigWig ----
_MAGIC, _CHROMS, _INDEX = 0x888FFC26, 0x78CA8C91, 0x2468ACE0


def _bw_chroms(f) -> tuple[str, dict[int, tuple[str, int]], int, bool]:
    head = f.read(64)
    for e in "<>":
        if struct.unpack(e + "I", head[:4])[0] == _MAGIC:
            break
    else:
        raise ValueError("no bigWig file")
    _, _, _, tree, _, index, _, _, _, _, unzip, _ = struct.unpack(e + "IHHQQQHHQQIQ", head)
    f.seek(tree)
    magic, _, key, _, _, _ = struct.unpack(e + "IIIIQQ", f.read(32))
    if magic != _CHROMS:
        raise ValueError("broken chromosome tree")
    chroms: dict[int, tuple[str, int]] = {}
    todo = [f.tell()]
    while todo:
        f.seek(todo.pop())
        leaf, _, n = struct.unpack(e + "BBH", f.read(4))
        for _ in range(n):
            name = f.read(key).rstrip(b"\0").decode()
            if leaf:
                i, size = struct.unpack(e + "II", f.read(8))
                chroms[i] = name, size
            else:
                at = f.tell()
                todo.append(struct.unpack(e + "Q", f.read(8))[0])
                f.seek(at + 8)
    return e, chroms, index, unzip > 0


def _bw_blocks(path: str) -> list[tuple[int, int]]:
    """(offset, size) of the data blocks."""
    with _open(path) as f:
        e, _, index, _ = _bw_chroms(f)
        f.seek(index)
        if struct.unpack(e + "I", f.read(4))[0] != _INDEX:
            raise ValueError("broken index")
        todo, out = [index + 48], []
        while todo:
            f.seek(todo.pop())
            leaf, _, n = struct.unpack(e + "BBH", f.read(4))
            for _ in range(n):
                f.read(16)
                if leaf:
                    out.append(struct.unpack(e + "QQ", f.read(16)))
                else:
                    todo.append(struct.unpack(e + "Q", f.read(8))[0])
        return sorted(out)


def read_bigwig_blocks(path: str, blocks: list[tuple[int, int]]) -> Iterator[tuple]:
    """sample, chrom, start, end, value of the rows in some blocks."""
    sample = os.path.basename(path).split(".")[0]
    with _open(path) as f:
        e, chroms, _, zipped = _bw_chroms(f)
        for offset, size in blocks:
            f.seek(offset)
            b = f.read(size)
            if zipped:
                b = zlib.decompress(b)
            chrom, start, _, step, span, kind, _, n = struct.unpack_from(e + "IIIIIBBH", b)
            name = chroms[chrom][0]
            for i in range(n):
                if kind == 1:
                    s, t, v = struct.unpack_from(e + "IIf", b, 24 + 12 * i)
                elif kind == 2:
                    s, v = struct.unpack_from(e + "If", b, 24 + 8 * i)
                    t = s + span
                else:
                    (v,) = struct.unpack_from(e + "f", b, 24 + 4 * i)
                    s = start + i * step
                    t = s + span
                yield sample, name, s, t, v


class BigWigSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "spanweave_bigwig"

    def schema(self) -> str:
        return "sample string, chrom string, start bigint, end bigint, value float"

    def reader(self, schema) -> DataSourceReader:
        return _BigWigReader(self.options["path"])


class _BigWigReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        out = []
        for p in _files(self.path):
            blocks = _bw_blocks(p)
            out += [InputPartition((p, blocks[i : i + 2000])) for i in range(0, len(blocks), 2000)] or [InputPartition((p, []))]
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from read_bigwig_blocks(*partition.value)


def bigwig_chroms(path: str) -> dict[str, int]:
    """S25 ``dchroms``."""
    with _open(path) as f:
        return dict(_bw_chroms(f)[1].values())


def register(spark) -> None:
    for s in (BamSource, BigWigSource):
        spark.dataSource.register(s)
