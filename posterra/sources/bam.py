"""BAM files in ranges: every task reads the blocks of its own part of a file.

A block of a BGZF file begins with the same sixteen bytes in all files that the usual writers make, so
Spark's text reader, with these bytes as its line separator, deals a file over tasks at block borders,
from any store that Spark reads. Records cross block and range borders: a task looks for the first whole record of its range by a chain of
records that all state a possible size, sequence and name, and parses from there. What a range has before its first and after its last
whole record is less than a record each; these ends are put together by file in a second, light pass, in which they must come out as
whole records, so that a wrong guess is an error and never a wrong row.

A gzip file without such blocks (no range can be read of it) is streamed by one task.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import groupby, islice
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema

# fixed values of the format: letters of bases and operations, and sizes of tags
_SEQ = "=ACMGRSVTWYHKDBN"
_OPS = "MIDNSHP=X"
_TAG_FORMS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f", "d": "<d"}
_PAIRS = [a + b for a in _SEQ for b in _SEQ]
_QUALITY = bytes((q + 33) % 256 for q in range(256))
_FIXED = struct.Struct("<iiiBBHHHiiii")
#: Fixed value: head of a block, before the two bytes of its size.
BLOCK_HEAD = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0"
#: Least and greatest size of a record without its size field.
LEAST_RECORD, MOST_RECORD = 32, 1 << 28
#: Records of a chain that proves a start, or at the end of a range two of them.
CHAIN = 8
#: Records of one frame, and bytes of one piece of a stream, whatever a file holds.
FRAME, PIECE = 20_000, 1 << 20


# --- bytes --------------------------------------------------------------------------------------


def inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Contents of gzip members that follow one another, in pieces of at most ``PIECE`` bytes."""
    z = zlib.decompressobj(31)
    for chunk in chunks:
        while chunk:
            out = z.decompress(chunk, PIECE)
            if out:
                yield out
            chunk = z.unconsumed_tail or z.unused_data
            if z.eof:
                z = zlib.decompressobj(31)


def inflate(data: bytes) -> bytes:
    """The whole contents of BGZF (or plain gzip) data."""
    return b"".join(inflated(iter([data])))


def block(body: bytes) -> bytes:
    """Contents of a block without its ``BLOCK_HEAD``."""
    size = struct.unpack_from("<H", body)[0] + 1
    if size != len(body) + len(BLOCK_HEAD):
        raise ValueError(f"a block states {size} bytes and has {len(body) + len(BLOCK_HEAD)}")
    out = zlib.decompress(body[2:-8], -15)
    if struct.unpack_from("<II", body, len(body) - 8) != (zlib.crc32(out), len(out)):
        raise ValueError("a block's checksum is wrong")
    return out


def parse_header(data: bytes) -> tuple[list[str], int]:
    """Reference names and where the records start."""
    if data[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    n = struct.unpack_from("<i", data, at)[0]
    at += 4
    names = []
    for _ in range(n):
        length = struct.unpack_from("<i", data, at)[0]
        if at + 8 + length > len(data):
            raise struct.error("the header goes on")
        names.append(data[at + 4 : at + 3 + length].decode())
        at += 8 + length
    return names, at


# --- records --------------------------------------------------------------------------------------


def _tags(data: bytes, at: int, end: int) -> dict[str, str]:
    out = {}
    while at + 3 <= end:
        key, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind == "A":
            out[key] = chr(data[at])
            at += 1
        elif kind in _TAG_FORMS:
            form = _TAG_FORMS[kind]
            out[key] = str(struct.unpack_from(form, data, at)[0])
            at += struct.calcsize(form)
        elif kind in "ZH":
            stop = data.index(0, at)
            out[key] = data[at:stop].decode()
            at = stop + 1
        elif kind == "B":
            form, n = _TAG_FORMS[chr(data[at])], struct.unpack_from("<i", data, at + 1)[0]
            size = struct.calcsize(form)
            out[key] = ",".join([chr(data[at]), *(str(struct.unpack_from(form, data, at + 5 + i * size)[0]) for i in range(n))])
            at += 5 + n * size
        else:
            raise ValueError(f"unknown tag type {kind!r}")
    return out


def parse_records(data: bytes, names: list[str]) -> Iterator[tuple]:
    """Rows of the alignment schema from whole records."""
    name = lambda i: names[i] if i >= 0 else "*"
    at = 0
    while at + 4 <= len(data):
        size, ref, pos, l_name, mapq, _, n_cigar, flag, l_seq, next_ref, next_pos, tlen = _FIXED.unpack_from(data, at)
        body = at + 36
        qname = data[body : body + l_name - 1].decode()
        body += l_name
        ops = struct.unpack_from(f"<{n_cigar}I", data, body)
        cigar = "".join(f"{o >> 4}{_OPS[o & 15]}" for o in ops) or "*"
        body += 4 * n_cigar
        seq = "".join(map(_PAIRS.__getitem__, data[body : body + (l_seq + 1) // 2]))[:l_seq] or "*"
        body += (l_seq + 1) // 2
        raw = data[body : body + l_seq]
        qual = "*" if not raw or raw[0] == 0xFF else raw.translate(_QUALITY).decode("latin-1")
        yield (qname, flag, name(ref), pos, mapq, cigar, name(next_ref), next_pos, tlen, seq, qual, _tags(data, body + l_seq, at + 4 + size))
        at += 4 + size


def whole(data: bytes, at: int = 0) -> int:
    """Where the last whole record ends, ``at`` being the start of one."""
    while at + 4 <= len(data) and (end := at + 4 + struct.unpack_from("<i", data, at)[0]) <= len(data):
        at = end
    return at


def _record_end(data: bytes, at: int, references: int) -> int | None:
    """Where the record at ``at`` ends, or None if none can begin there; its fixed part is in ``data``."""
    size, ref, pos, l_name, _, _, n_cigar, _, l_seq, next_ref, next_pos, _ = _FIXED.unpack_from(data, at)
    if not (LEAST_RECORD <= size <= MOST_RECORD and -1 <= ref < references and -1 <= next_ref < references and pos >= -1 and next_pos >= -1 and l_name and l_seq >= 0):
        return None
    if LEAST_RECORD + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq > size:
        return None
    name, ops = data[at + 36 : at + 36 + l_name], data[at + 36 + l_name : at + 36 + l_name + 4 * min(n_cigar, 64) : 4]
    if len(name) == l_name and (name[-1] or not all(32 < c < 127 for c in name[:-1])):
        return None
    return None if any(op & 15 >= len(_OPS) for op in ops) else at + 4 + size


def _starts(data: bytes, at: int, references: int, ended: bool) -> bool | None:
    """Whether a chain of records begins at ``at``; None if it takes more data to tell."""
    for n in range(CHAIN):
        if at + _FIXED.size > len(data):
            return n > 1 if ended else None
        end = _record_end(data, at, references)
        if end is None:
            return False
        if end > len(data):
            return n > 1 if ended else None
        at = end
    return True


def first_record(data: bytes, references: int, ended: bool) -> int | None:
    """Where the first whole record of a range begins, or None if ``data``, which is all of it if ``ended``, doesn't tell."""
    for at in range(len(data)):
        begins = _starts(data, at, references, ended)
        if begins is None or begins:
            return at if begins else None
    return None


HEAD, RECORDS, TAIL, ALL = "head", "records", "tail", "all"


def parts(pieces: Iterator[bytes], references: int, opens: bool) -> Iterator[tuple[str, bytes]]:
    """The contents of a range as its head, whole records, and tail; or as one that has no start.

    ``opens`` says that the range is the first of its file, whose header it leaves out.
    """
    data, found = b"", False
    for piece in pieces:
        data += piece
        if not found:
            at = _after_header(data) if opens else first_record(data, references, False)
            if at is None:
                continue
            yield HEAD, b"" if opens else data[:at]
            data, found = data[at:], True
        if end := whole(data):
            yield RECORDS, data[:end]
            data = data[end:]
    if not found and not opens and (at := first_record(data, references, True)) is not None:
        yield HEAD, data[:at]
        end, found = whole(data, at), True
        yield RECORDS, data[at:end]
        data = data[end:]
    yield TAIL if found else ALL, data


def _after_header(data: bytes) -> int | None:
    try:
        return parse_header(data)[1]
    except (struct.error, IndexError):
        return None


# --- ranges of files --------------------------------------------------------------------------------


def _located(url: str) -> str:
    """One form of ``file:/a`` and ``file:///a``."""
    parts = urlsplit(url)
    return f"{parts.scheme}://{parts.netloc}{parts.path}"


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[bytes]]]:
    """(path, first byte, contents) of the ranges of a task, from its lines in order."""
    lines = ((p, s, v) for b in batches for p, s, v in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
    for (path, start), own in groupby(lines, key=lambda x: x[:2]):
        bodies = (v for _, _, v in own)
        # nothing stands before the first block of a file; else it has other blocks, or none
        ahead = next(bodies) if start == 0 else b""
        yield _located(path), start, inflated(iter([ahead])) if ahead else map(block, bodies)


def _whole_records(batches: Iterator[pa.RecordBatch], names: dict[str, list[str]]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in schema.ALIGNMENT.replace("map<string,string>", "map").split(", ")]
    for path, start, pieces in _ranges(batches):
        rows = (row for kind, data in parts(pieces, len(names[path]), start == 0) if kind == RECORDS for row in parse_records(data, names[path]))
        while frame := list(islice(rows, FRAME)):
            yield pd.DataFrame(frame, columns=columns)


_ENDS = "path string, start long, head binary, tail binary"


def _ends(batches: Iterator[pa.RecordBatch], names: dict[str, list[str]]) -> Iterator[pa.RecordBatch]:
    for path, start, pieces in _ranges(batches):
        ends = {HEAD: None, TAIL: b""}
        for kind, data in parts(pieces, len(names[path]), start == 0):
            if kind == ALL:
                ends[TAIL] = data
            elif kind != RECORDS:
                ends[kind] = data
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([start], pa.int64()), pa.array([ends[HEAD]], pa.binary()), pa.array([ends[TAIL]], pa.binary())], names=["path", "start", "head", "tail"])


def _between(batches: Iterator[pa.RecordBatch], names: dict[str, list[str]]) -> Iterator[pd.DataFrame]:
    """Records that cross ranges, from the ends of a file's ranges in order; a range without a head adds all it has."""
    columns = [c.split()[0] for c in schema.ALIGNMENT.replace("map<string,string>", "map").split(", ")]
    path, data, opening = None, b"", True

    def closed() -> bytes:
        at = _after_header(data) if opening else 0
        if at is None or whole(data, at) != len(data):
            raise ValueError(f"records of {path} don't meet between ranges, or the file is cut off")
        return data[at:]

    def frames() -> Iterator[pd.DataFrame]:
        if rows := list(parse_records(closed(), names[path])):
            yield pd.DataFrame(rows, columns=columns)

    for batch in batches:
        for own, start, head, tail in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != path:
                if path is not None:
                    yield from frames()
                path, data, opening = own, b"", True
            if head is None:
                data += tail
                continue
            if start == 0:
                data, opening = tail, False
                continue
            data += head
            yield from frames()
            data, opening = tail, False
    if path is not None:
        yield from frames()


def head_of(spark: SparkSession, path: str, size: int = 65536) -> bytes:
    """First bytes of a file, by Spark's own file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def references(spark: SparkSession, path: str) -> list[str]:
    """Names of a file's sequences, from as much of its front as its header takes."""
    size = 1 << 16
    while True:
        head = head_of(spark, path, size)
        data = b"".join(inflated(iter([head])))
        try:
            return parse_header(data)[0]
        except (struct.error, IndexError):
            if len(head) < size:
                raise ValueError(f"the header of {path} is cut off") from None
            size *= 4


def _task(f: Callable, names: dict[str, list[str]]) -> Callable:
    return lambda batches: f(batches, names)


def _frames_of(f: Callable, names: dict[str, list[str]]) -> Callable:
    """The same for frames, which Spark's pandas functions get."""
    return lambda frames: f((pa.RecordBatch.from_pandas(x, preserve_index=False) for x in frames), names)


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of BAM files on any store that Spark reads, in ranges of ``spark.sql.files.maxPartitionBytes``.

    Rows of a range stand in the file's order; records that cross ranges come after all others.
    The driver reads each file's header; equal headers are kept once.
    """
    lines = spark.read.option("lineSep", BLOCK_HEAD.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    seen: dict[tuple[str, ...], list[str]] = {}
    names = {}
    jvm = spark.sparkContext._jvm
    for url in lines.inputFiles():
        file = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(url))
        own = references(spark, file.toString())
        names[_located(url)] = seen.setdefault(tuple(own), own)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("body"))
    inner = lines.mapInPandas(_frames_of(_whole_records, names), schema.ALIGNMENT)
    ends = lines.mapInArrow(_task(_ends, names), _ENDS)
    ends = ends.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").sortWithinPartitions("path", "start")
    return inner.unionByName(ends.mapInPandas(_frames_of(_between, names), schema.ALIGNMENT))
