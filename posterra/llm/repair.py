"""Conversations brought back to a sequence of turns that a chat model can be trained on.

A row's fault is the first of: blank, duplicate (same role and text as an earlier row of its
conversation), truncated (last visible character isn't one of ``.!?``). Rows are edited at least
cost until the roles' initials read ``(s?(ua)+)?``: Keep 0, Rerole 3, Delete 4 (a must for blank and duplicate
rows), Insert an empty turn 3, and 3 more for a truncated row that isn't deleted. Of equal costs the audit,
the initials of the edits in order, that comes first in ASCII counts. An audit fixes all roles.

Without the texts, rows are sorted over all partitions and cut into segments of at most ``SEGMENT`` rows of
a conversation, each a word over nine symbols (initial and fault). Segments are dealt by hash, and within a
batch of them a recursive query of DuckDB advances one row of all segments in each step and keeps, for
each state of the grammar, the least (cost, audit) that leads there. A segment that may go on from another
starts in each of the four states. Segments of a conversation are then joined in order, so that a conversation of
any length is worked on by many tasks. Two audits of equal cost and state are never prefixes of each other, since what an audit
costs follows from its letters; so the least prefix is part of the least whole.

The texts move once: they are dealt by conversation behind its audit and read in order, a row at a time.

Cases: null roles and texts are one space (so a null text is blank); a null conversation is one of its own; null turns come
first and have no gaps; rows that share a turn come by role, then by a digest of role and text; of
repeated rows all but one are duplicates; other columns are ignored; an empty table gives no rows. A conversation in ``every`` without rows has zeros,
an empty audit and an empty text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import partitions
from .turns import changes, in_order

SEGMENT = 128
#: Characters of audits that a batch of segments may come to, at most, but for a single segment.
BATCH = 1 << 24
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
STATES = range(4)
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: Inserts that end a conversation in each state.
_CLOSING = ("", "II", "I", "")
NONE, BLANK, DUPLICATE, CUT = range(4)
VISIBLE = r"[^\x20\x09-\x0D]"


def moves() -> list[tuple[str, int, int, int, str]]:
    """(symbol, state, next state, cost, audit) of one row, an insert before it included; a second one would come back to where it began.

    A symbol is the initial of a role (``o`` for any but s, u and a), a capital if the text is truncated, or ``D`` for a row that must go.
    """
    out = []
    for symbol in "suaoSUAOD":
        initial, cut = symbol.lower(), TRUNCATED * (symbol != "D" and symbol.isupper())
        for state in STATES:
            for audit, at in (("", state), ("I", _NEXT[state, "a" if state == 2 else "u"])):
                out.append((symbol, state, at, DELETE + INSERT * len(audit), audit + "D"))
                if symbol == "D":
                    continue
                if (at, initial) in _NEXT:
                    out.append((symbol, state, _NEXT[at, initial], KEEP + cut + INSERT * len(audit), audit + "K"))
                out.append((symbol, state, _NEXT[at, "a" if at == 2 else "u"], REROLE + cut + INSERT * len(audit), audit + "R"))
    return out


# --- segments -----------------------------------------------------------------------------------


def _coded(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, initial, fault) of each row, without its text."""
    rows = turns.select(
        "conv_id", "turn", "role", F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))).alias("digest"),
        F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o").alias("initial"),
        F.when(~F.col("text").rlike(VISIBLE), BLANK).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT).otherwise(NONE).alias("fault"),
    )
    # a row is a duplicate if an equal one has an earlier turn; equal rows of one turn lie side by side later
    first = rows.groupBy("conv_id", "digest").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count(F.lit(1)).alias("n"), F.count("turn").alias("known"))
    first = first.where((F.col("low") != F.col("high")) | ((F.col("known") > 0) & (F.col("known") < F.col("n"))))
    first = first.select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), F.when(F.col("known") == F.col("n"), F.col("low")).alias("first_turn"))
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    again = F.col("d").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first_turn"))
    return rows.select("conv_id", "turn", "role", "digest", "initial", F.when((F.col("fault") != BLANK) & again, DUPLICATE).otherwise(F.col("fault")).cast("int").alias("fault"))


_SEGMENTS = "conv_id long, part long, opens boolean, codes string, ends string, n long, blank long, duplicate long, truncated long, illegal long, n_turns long, low long, high long"
_LEGAL = ("su", "ua", "au")
_IS_LEGAL = np.zeros((256, 256), dtype=bool)
for _pair in _LEGAL:
    _IS_LEGAL[ord(_pair[0]), ord(_pair[1])] = True


def _segments(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Segments of sorted rows and what they count within themselves; ``opens`` says that a segment is known to be the first of its conversation."""
    part = TaskContext.get().partitionId() << 40
    before = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys, turns = batch.column(0), batch.column(1)
        digests = np.array(batch.column(2).to_pylist(), dtype=object)
        initial = np.frombuffer("".join(batch.column(3).to_pylist()).encode(), dtype=np.uint8)
        fault = batch.column(4).to_numpy().copy()
        known, turn = np.asarray(turns.is_valid()), np.asarray(turns.fill_null(0))
        begins = changes(keys)
        new = np.zeros(n, dtype=bool)
        new[begins] = True
        same_turn = np.zeros(n, dtype=bool)
        same_turn[1:] = ~new[1:] & (turn[1:] == turn[:-1]) & (known[1:] == known[:-1])
        same = same_turn.copy()
        same[1:] &= digests[1:] == digests[:-1]
        if before is not None and before[0] == keys[0].as_py():
            new[0] = False
            same[0] = before[1:] == (turns[0].as_py(), digests[0])
        else:
            new[0] = before is not None
        before = keys[n - 1].as_py(), turns[n - 1].as_py(), digests[n - 1]
        fault[same & (fault != BLANK)] = DUPLICATE
        codes = np.where(fault == CUT, initial - 32, initial).astype(np.uint8)
        codes[(fault == BLANK) | (fault == DUPLICATE)] = ord("D")
        at = np.flatnonzero((np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))) % size == 0)
        stops = np.append(at[1:], n)
        illegal, distinct = np.zeros(n, dtype=bool), known & ~same_turn
        illegal[1:] = ~_IS_LEGAL[initial[:-1], initial[1:]]
        illegal[at], distinct[at] = False, known[at]
        count = lambda flags: pa.array(np.add.reduceat(flags.astype(np.int64), at))
        bound = lambda f, none: pa.array(f.reduceat(np.where(known, turn, none), at), mask=~np.logical_or.reduceat(known, at))
        word, letters = codes.tobytes().decode(), initial.tobytes().decode()
        spans = list(zip(at.tolist(), stops.tolist(), strict=True))
        yield pa.RecordBatch.from_arrays(
            [
                keys.take(pa.array(at)), pa.array(part + np.arange(len(at))), pa.array(new[at]), pa.array([word[a:b] for a, b in spans]), pa.array([letters[a] + letters[b - 1] for a, b in spans]),
                pa.array(stops - at), count(fault == BLANK), count(fault == DUPLICATE), count(fault == CUT), count(illegal), count(distinct),
                bound(np.minimum, np.iinfo(np.int64).max), bound(np.maximum, np.iinfo(np.int64).min),
            ],
            names=[f.split()[0] for f in _SEGMENTS.split(", ")],
        )
        part += len(at)


# --- least edits ----------------------------------------------------------------------------------

WALK = """
WITH RECURSIVE walk(id, done, start, state, best) AS (
  SELECT id, 0, start, start, {'cost': 0::BIGINT, 'audit': ''} FROM segments JOIN (VALUES (0), (1), (2), (3)) s(start) ON start = 0 OR NOT opens
  UNION ALL
  SELECT w.id, w.done + 1, w.start, m.next, min({'cost': w.best.cost + m.cost, 'audit': w.best.audit || m.audit})
  FROM walk w JOIN segments USING (id) JOIN moves m ON m.state = w.state AND m.symbol = codes[w.done + 1]
  GROUP BY w.id, w.done, w.start, m.next
)
SELECT id, start, state, best.cost AS cost, best.audit AS audit FROM walk JOIN segments USING (id) WHERE done = length(codes) ORDER BY id
"""
_WALKED = _SEGMENTS.replace("codes string", "ways array<struct<start: int, state: int, cost: long, audit: string>>")


def _walked(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Segments with the cheapest ways between states, a batch of them at a time."""
    db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"})
    db.execute("CREATE TABLE moves(symbol VARCHAR, state INTEGER, next INTEGER, cost BIGINT, audit VARCHAR)")
    db.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?)", moves())
    for batch in batches:
        sizes = batch.column(5).to_numpy()
        weight = np.cumsum(np.where(batch.column(2).to_numpy(zero_copy_only=False), 4, 16) * sizes * (sizes + 32))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(weight, (weight[at - 1] if at else 0) + limit, side="right")))
            rows = batch.slice(at, stop - at)
            db.register("given", pa.table({"id": pa.array(np.arange(len(rows))), "opens": rows.column(2), "codes": rows.column(3)}))
            db.execute("CREATE OR REPLACE TABLE segments AS SELECT * FROM given")
            found = db.sql(WALK).to_arrow_table().combine_chunks()
            db.unregister("given")
            ptr = np.searchsorted(found.column("id").to_numpy(), np.arange(len(rows) + 1)).astype(np.int32)
            fields = [("start", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]
            ways = pa.StructArray.from_arrays([found.column(n).combine_chunks().cast(t) if found.num_rows else pa.array([], t) for n, t in fields], names=[n for n, _ in fields])
            columns = {n: rows.column(i) for i, n in enumerate(rows.schema.names)} | {"codes": pa.ListArray.from_arrays(pa.array(ptr), ways)}
            yield pa.RecordBatch.from_arrays([*columns.values()], names=["ways" if n == "codes" else n for n in columns])
            at = stop
    db.close()


def _text(node: tuple | None, stop: tuple | None = None) -> str:
    """The pieces of a chain of (chain before, piece) behind ``stop``."""
    pieces = []
    while node is not stop:
        node, piece = node
        pieces.append(piece)
    return "".join(reversed(pieces))


def _less(a: tuple, b: tuple) -> bool:
    """Whether the text of chain a comes before that of b, which has as many pieces; what they share is not read."""
    x, y = a, b
    while x is not y:
        x, y = x[0], y[0]
    return _text(a, x) < _text(b, x)


class _Whole:
    """A conversation of which segments are added in order."""

    def __init__(self):
        self.ways: dict[int, tuple[int, tuple | None]] = {0: (0, None)}
        self.counts = [0, 0, 0, 0]
        self.n_turns = 0
        self.low = self.high = self.last = None

    def add(self, ways: list[dict], ends: str, counts: list[int], n_turns: int, low: int | None, high: int | None) -> None:
        onward: dict[int, tuple[int, tuple]] = {}
        for way in ways:
            if way["start"] in self.ways:
                cost, chain = self.ways[way["start"]]
                new, old = (cost + way["cost"], (chain, way["audit"])), onward.get(way["state"])
                if old is None or new[0] < old[0] or (new[0] == old[0] and _less(new[1], old[1])):
                    onward[way["state"]] = new
        self.ways = onward
        self.counts = [a + b for a, b in zip(self.counts, counts, strict=True)]
        self.counts[3] += self.last is not None and self.last + ends[0] not in _LEGAL
        self.n_turns += n_turns - (low is not None and low == self.high)
        if low is not None:
            self.low, self.high = (low if self.low is None else self.low), high
        self.last = ends[1]

    def row(self) -> tuple:
        cost, audit = min((cost + INSERT * len(_CLOSING[state]), _text(chain) + _CLOSING[state]) for state, (cost, chain) in self.ways.items())
        return 0 if self.low is None else self.high - self.low + 1 - self.n_turns, *self.counts, cost, audit


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(column[i].as_py() for column in batch.columns)


def _wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    at, whole = None, None
    for key, _, _, ways, ends, _, *counts, n_turns, low, high in _rows(batches):
        if whole is None or key != at:
            if whole is not None:
                yield at, *whole.row()
            at, whole = key, _Whole()
        whole.add(ways, ends, counts, n_turns, low, high)
    if whole is not None:
        yield at, *whole.row()


AUDITS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _schema(fields: str) -> pa.Schema:
    return pa.schema([(f.split()[0], _TYPES[f.split()[1]]) for f in fields.split(", ")])


def _batched(rows: Iterator[tuple], schema: pa.Schema, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Batches of at most 4,096 rows and about ``limit`` characters."""
    waiting: list[tuple] = []
    size = 0
    for row in rows:
        waiting.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(waiting) == 4096 or size >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*waiting, strict=True), schema.types, strict=True)], schema=schema)
            waiting, size = [], 0
    if waiting:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*waiting, strict=True), schema.types, strict=True)], schema=schema)


def _filled(turns: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return turns.select(F.col(key).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), blank(role).alias("role"), blank(text).alias("text"))


def audited(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT, batch: int = BATCH) -> DataFrame:
    """Rows of ``AUDITS``: the faults of each conversation, and the cost and initials of its cheapest edits."""
    spark = turns.sparkSession
    rows = in_order(_coded(_filled(turns, key, turn, role, text)), "conv_id", F.col("turn"), F.col("role"), F.col("digest"))
    cut = rows.select("conv_id", "turn", "digest", "initial", "fault").mapInArrow(lambda it: _segments(it, segment), _SEGMENTS)
    walked = cut.repartition(partitions(spark), "conv_id", "part").mapInArrow(lambda it: _walked(it, batch), _WALKED)
    joined = walked.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "part")
    return joined.mapInArrow(lambda it: _batched(_wholes(it), _schema(AUDITS)), AUDITS)


# --- repaired turns -------------------------------------------------------------------------------

REPAIRED = "conv_id long, place long, edit string, role string, text string"


def _edited(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, place, edit, role, text) from rows that follow the header of their conversation, which has the audit as its text."""
    key, audit, at, place, state = None, "", 0, 0, 0

    def inserts() -> Iterator[tuple]:
        nonlocal at, place, state
        while at < len(audit) and audit[at] == "I":
            state = 3 if state == 2 else 2
            yield key, place, "I", "assistant" if state == 3 else "user", ""
            at, place = at + 1, place + 1

    for own, header, role, text in rows:
        if header:
            yield from inserts()
            key, audit, at, place, state = own, text, 0, 0, 0
            continue
        yield from inserts()
        edit, at = audit[at], at + 1
        if edit == "D":
            continue
        state = 1 if edit == "K" and role[:1] == "s" else 3 if state == 2 else 2
        yield key, place, edit, role if edit == "K" else "assistant" if state == 3 else "user", text
        place += 1
    yield from inserts()


def _behind_audits(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, header, role, text): each conversation in one partition, in order, behind its audit."""
    heads = audits.select("conv_id", F.lit(True).alias("header"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"), F.col("audit").alias("text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")))
    rows = heads.unionByName(turns.select("conv_id", F.lit(False).alias("header"), "turn", "role", digest.alias("digest"), "text"))
    rows = rows.repartition(partitions(turns.sparkSession), "conv_id")
    return rows.sortWithinPartitions("conv_id", F.desc("header"), "turn", "role", "digest").select("conv_id", "header", "role", "text")


def repaired(turns: DataFrame, audits: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of the repaired conversations; ``audits`` comes from ``audited`` on the same turns."""
    rows = _behind_audits(_filled(turns, key, turn, role, text), audits)
    return rows.mapInArrow(lambda it: _batched(_edited(_rows(it)), _schema(REPAIRED)), REPAIRED)


def _hashed(turns: Iterator[tuple]) -> Iterator[tuple]:
    at, digest = None, None
    for key, place, _, role, text in turns:
        if place == 0:
            if digest is not None:
                yield at, digest.hexdigest()
            at, digest = key, hashlib.sha256()
        digest.update(f"{chr(10) * (place > 0)}{role}:{text}".encode("utf-8", "surrogatepass"))
    if digest is not None:
        yield at, digest.hexdigest()


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the output of ``repaired`` as it stands, for conversations with a turn left."""
    fields = "conv_id long, repaired_sha256 string"
    return repaired.mapInArrow(lambda it: _batched(_hashed(_rows(it)), _schema(fields)), fields)
