"""Conversations as text for training, with the spans that the loss covers, and back.

A turn is written as ``<|turn|>role<|text|>text</s>``. Roles and texts may hold anything: a
backslash in them is doubled, and one is put behind the first character of each control string
(the three marks above, ``<s>``, ``[INST]`` and ``[/INST]``), so that a formatted text holds no control
string but its own marks. Dropping a backslash that none follows, and halving the others, undoes it.

Rows are sorted over all partitions, so a conversation of any length is dealt over tasks. A block of
turns is assembled by columns: lengths of all segments, their cumulative offsets and the place of
each byte are computed in numpy, and marks, roles and texts are copied into one Arrow buffer that is allocated once.
A conversation's rows of a block make one piece; its text is its pieces in the order of ``part``.

Cases: a null text or role is an empty one; a null conversation is one of its own; null turns come
first; rows that share a turn come by role, then by a hash of their text; repeated rows are turns
of their own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import partitions
from .textblocks import Block, blocks, strings
from .turns import changes, in_order

# fixed values: the marks of a turn, and what else a tokenizer may take for a control string
TURN, TEXT, END = b"<|turn|>", b"<|text|>", b"</s>"
CONTROL = (TURN, TEXT, END, b"<s>", b"[INST]", b"[/INST]")
#: Bytes of a conversation that a task holds back before it leaves it to the second step.
HELD = 1 << 23
LEARNED = b"assistant"
FORMATTED = "conv_id long, part long, n_turns long, formatted string, loss array<struct<start: int, end: int>>"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


# --- writing ------------------------------------------------------------------------------------


def _breaks(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Bytes that a backslash follows: backslashes, and the first of each control string within one text."""
    out = buf == ord("\\")
    ends = np.repeat(offs[1:], np.diff(offs))
    opening = np.flatnonzero((buf == ord("<")) | (buf == ord("[")))
    for control in CONTROL:
        at = opening[opening + len(control) <= ends[opening]]
        for k, byte in enumerate(control):
            at = at[buf[at + k] == byte]
        out[at] = True
    return out


def assembled(roles: Block, texts: Block, pieces: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The formatted pieces, which begin at turns ``pieces``, and the first and last code point of each turn's text within its piece."""
    n = len(texts)
    sources = []
    for block in (roles, texts):
        extra = _breaks(block.buf, block.offs)
        upto = np.zeros(len(block.buf) + 1, dtype=np.int64)
        np.cumsum(extra, out=upto[1:])
        sources.append((block, extra, upto, np.diff(block.offs + upto[block.offs])))
    lengths = np.empty((n, 5), dtype=np.int64)
    lengths[:, 0], lengths[:, 2], lengths[:, 4] = len(TURN), len(TEXT), len(END)
    lengths[:, 1], lengths[:, 3] = sources[0][3], sources[1][3]
    offsets = np.zeros(n * 5 + 1, dtype=np.int64)
    np.cumsum(lengths.reshape(-1), out=offsets[1:])
    starts = offsets[:-1].reshape(n, 5)
    store = pa.allocate_buffer(int(offsets[-1]))
    out = np.frombuffer(store, dtype=np.uint8)
    for column, mark in ((0, TURN), (2, TEXT), (4, END)):
        out[starts[:, column, None] + np.arange(len(mark))] = np.frombuffer(mark, dtype=np.uint8)
    for column, (block, extra, upto, _) in zip((1, 3), sources, strict=True):
        shift = starts[:, column] - block.offs[:-1] - upto[block.offs[:-1]]
        place = np.arange(len(block.buf)) + upto[:-1] + np.repeat(shift, np.diff(block.offs))
        out[place] = block.buf
        out[place[extra] + 1] = ord("\\")
    points = np.zeros(len(out) + 1, dtype=np.int64)
    np.cumsum((out & 0xC0) != 0x80, out=points[1:])
    piece = np.repeat(np.arange(len(pieces)), np.diff(np.append(pieces, n)))
    first = points[starts[pieces, 0]][piece]
    bounds = np.append(starts[pieces, 0], offsets[-1])
    array = pa.LargeStringArray.from_buffers(len(pieces), pa.py_buffer(bounds), store)
    return array.cast(pa.string()), points[starts[:, 3]] - first, points[starts[:, 4]] - first


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId() << 40
    for batch in batches:
        role_buf, role_offs, role_valid = strings(batch.column(1))
        for block in blocks(batch.column(2)):
            here = slice(block.first, block.first + len(block))
            offs = role_offs[block.first : block.first + len(block) + 1]
            roles = Block(block.first, role_buf[offs[0] : offs[-1]], offs - offs[0], role_valid[here])
            keys = batch.column(0).slice(block.first, len(block))
            begins = changes(keys)
            formatted, start, end = assembled(roles, block, begins)
            raw, bounds = roles.buf.tobytes(), roles.offs.tolist()
            learned = np.flatnonzero([raw[a:b] == LEARNED for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
            spans = pa.StructArray.from_arrays([pa.array(x[learned].astype(np.int32)) for x in (start, end)], names=["start", "end"])
            ptr = np.searchsorted(learned, np.append(begins, len(block))).astype(np.int32)
            sizes = np.diff(np.append(begins, len(block)))
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(begins)), pa.array(part + np.arange(len(begins))), pa.array(sizes), formatted, pa.ListArray.from_arrays(pa.array(ptr), spans)],
                names=["conv_id", "part", "n_turns", "formatted", "loss"],
            )
            part += len(begins)


def formatted(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, part, n_turns, formatted, loss): pieces of conversations in order, ``loss`` being the code points of the texts to learn."""
    rows = turns.select(F.col(key).cast("long").alias("conv_id"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"), F.col(turn).cast("long").alias("turn"))
    rows = in_order(rows, "conv_id", F.col("turn"), F.col("role"), F.xxhash64("text"))
    return rows.select("conv_id", "role", "text").mapInArrow(_format, FORMATTED)


# --- reading --------------------------------------------------------------------------------------

_MARKS = re.compile("|".join(re.escape(m.decode()) for m in (TURN, TEXT, END)))


def unescaped(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text


def parsed(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a piece."""
    fields = _MARKS.split(text)
    if len(fields) % 3 != 1 or any(fields[::3]):
        raise ValueError("not a formatted conversation")
    return [(unescaped(r), unescaped(t)) for r, t in zip(fields[1::3], fields[2::3], strict=True)]


class _Digest:
    """What is read back of one conversation, a piece at a time."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def add(self, formatted: str, spans: list[dict]) -> None:
        for role, text in parsed(formatted):
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            self.n_turns += 1
        for span in spans:
            text = unescaped(formatted[span["start"] : span["end"]])
            self.loss.update(text.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(text)
        self.formatted_chars += len(formatted)

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


_READ = "conv_id long, part long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, formatted string, loss array<struct<start: int, end: int>>"
_READ_TYPES = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
     ("formatted_chars", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
)


def _grouped(rows: Iterator[tuple], schema: pa.Schema, text: int | None = None, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Batches of at most 4,096 rows and about ``limit`` characters in column ``text``."""
    waiting: list[tuple] = []
    size = 0
    for row in rows:
        waiting.append(row)
        size += len(row[text] or "") if text is not None else 0
        if len(waiting) == 4096 or size >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*waiting, strict=True), schema.types, strict=True)], schema=schema)
            waiting, size = [], 0
    if waiting:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*waiting, strict=True), schema.types, strict=True)], schema=schema)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(column[i].as_py() for column in batch.columns)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """A digest of each conversation that a task has whole; the pieces of the first, the last and any of over ``HELD`` characters go on as they are."""
    none = (None,) * 5
    at, edge, held, digest, size = None, True, [], _Digest(), 0
    began = False
    for key, part, _, formatted, loss in _pieces(batches):
        if began and key != at:
            if not edge:
                yield at, held[0][1], *digest.row(), None, None
            edge, held, digest, size = False, [], _Digest(), 0
        began, at = True, key
        piece = (key, part, *none, formatted, loss)
        if edge:
            yield piece
            continue
        held.append(piece)
        size += len(formatted)
        if size > HELD:
            yield from held
            edge, held = True, []
        else:
            digest.add(formatted, loss)
    yield from held


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows sorted by conversation and part: digests stay, pieces of a conversation are read one after the other."""
    at, digest = None, None
    for key, _, *row, formatted, loss in _pieces(batches):
        if digest is not None and (key != at or formatted is None):
            yield at, *digest.row()
            digest = None
        if formatted is None:
            yield key, *row
            continue
        at, digest = key, digest or _Digest()
        digest.add(formatted, loss)
    if digest is not None:
        yield at, *digest.row()


def read_back(pieces: DataFrame) -> DataFrame:
    """Rows of ``DIGEST``, a conversation each, from the output of ``formatted`` as it stands.

    Most conversations are read where they were written. Those that lie in several tasks are
    read in one, piece by piece, as a hash of a text takes it in order.
    """
    digest = pa.schema([f for f in _READ_TYPES if f.name not in ("part", "formatted", "loss")])
    rows = pieces.mapInArrow(lambda it: _grouped(_read(it), _READ_TYPES, 7), _READ)
    rows = rows.repartition(partitions(pieces.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part")
    return rows.mapInArrow(lambda it: _grouped(_joined(it), digest), DIGEST)
