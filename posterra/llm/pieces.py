"""SentencePiece encoding and decoding with a suffix array over the distinct units of a batch.

Text is cut into units that no piece crosses: a run of spaces with what follows it up to
the next space, and single characters that occur in no longer piece (line breaks). The
distinct units of a batch that a task has not met before are concatenated and indexed by
a suffix array over words of eight bytes: all suffixes sorted by their first word, and those
that begin as a longer piece does by their next one, and so on. Every piece of the vocabulary
is looked up by binary search, which gives the range of all its occurrences at once; the
resulting edges (start, length, piece) are sorted by position. Then they are relaxed:

* ``unigram``: left to right, the best score to reach each position over its incoming
  edges, for all units in step;
* ``bpe``: of the edges that join two neighbouring symbols the best scored one (ties: the
  leftmost) is taken in every unit at once, which changes the edges of its two neighbours
  and of no other symbol, until no edge joins two symbols; a unit of more
  than ``LONG`` characters takes its edges from a heap instead, in time that grows with its
  length and not with the square.

Characters that no piece covers become byte pieces. Decoding gathers the bytes of all
pieces of a batch. Units already encoded are remembered by a task up to ``REMEMBERED``.

Cases: a null text gives null, an empty one no piece; U+2581 in a text means a blank and
decodes to one; equal rows get equal rows; columns other than the named ones are ignored;
an empty table gives no rows. The model must not normalise (``identity``), must add the
leading blank, and must have byte pieces; another is refused.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblocks import blocks, byte_hasher

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
REMEMBERED = 1 << 19
LONG = 256
BLANK = "▁".encode()
WORD = 8
DECODED = 1 << 18
NONE = 1 << 30


class Vocabulary:
    """Pieces as bytes with scores; byte pieces apart. A blank is one byte here, and a zero byte, which ends a unit, is 0xF8."""

    def __init__(self, pieces: list[bytes], scores: np.ndarray, ids: np.ndarray, byte_ids: np.ndarray, algorithm: str):
        self.algorithm = algorithm
        body = [p.decode("utf-8") for p in pieces]
        if any("▁" in p.lstrip("▁") for p in body):
            raise ValueError("a piece holds a blank after another character")
        if any(b" " in p for p in pieces):
            raise ValueError("a piece holds a blank that is not U+2581")
        plain = [p.replace(BLANK, b" ").replace(b"\0", b"\xf8") for p in pieces]
        order = np.argsort(np.array(plain, dtype=object), kind="stable")
        self.pieces, self.scores, self.ids = [plain[i] for i in order], scores[order], ids[order]
        self.rank = np.unique(-self.scores, return_inverse=True)[1]
        self.lengths = np.array([len(p) for p in self.pieces], dtype=np.int64)
        self.longest = int(self.lengths.max())
        self.levels = self._levels()
        self.byte_ids = byte_ids
        joined = {c for p in body if len(p) > 1 for c in p}
        self.alone = np.array([chr(b) not in joined for b in range(128)] + [False] * 128)
        self.alone[0x20] = False
        most = max(int(ids.max(initial=0)), int(byte_ids.max(initial=0))) + 1
        out = [b""] * most
        for p, i in zip(pieces, ids.tolist(), strict=True):
            out[i] = p.replace(BLANK, b" ")
        for b, i in enumerate(byte_ids.tolist()):
            out[i] = bytes([b])
        self.out_bytes = np.frombuffer(b"".join(out), dtype=np.uint8)
        self.out_offs = np.concatenate(([0], np.cumsum([len(x) for x in out])))

    def _levels(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By word of the pieces: (group, low, high, piece) of the pieces that end in it, then of the beginnings, one a group of the next word, of those that go on."""
        n = -(-self.longest // WORD)
        words = np.array(self.pieces, dtype=f"S{n * WORD}").view(">u8").reshape(-1, n).astype(np.uint64)
        group, rest, out = np.zeros(len(words), np.int64), np.arange(len(words)), []
        for k in range(n):
            free = (k + 1) * WORD - self.lengths[rest]
            here, on = rest[free >= 0], rest[free < 0]
            # pieces are sorted, so those with the same beginning are neighbours
            head = np.ones(len(on), dtype=bool)
            head[1:] = (words[on[1:], k] != words[on[:-1], k]) | (group[on[1:]] != group[on[:-1]])
            low = np.concatenate((words[here, k], words[on[head], k]))
            above = np.concatenate(((np.uint64(1) << (8 * free[free >= 0]).astype(np.uint64)) - np.uint64(1), np.zeros(head.sum(), np.uint64)))
            out.append((np.concatenate((group[here], group[on[head]])), low, low | above, here))
            group[on] = np.cumsum(head) - 1
            rest = on
        return out

    @staticmethod
    def load(path: str = MODEL, algorithm: str = "bpe") -> Vocabulary:
        """The model of a file, read once by a worker as long as the file stays as it is."""
        file = os.stat(path)
        return _load(path, algorithm, file.st_mtime_ns, file.st_size)

    @staticmethod
    def read(path: str, algorithm: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.encode(" a  b", out_type=str)[:1] != ["▁"] or sp.decode(sp.encode("ﬁ ｆ")) != "ﬁ ｆ":
            raise ValueError("only models without normalisation are supported")
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        ids = np.array([i for i in range(n) if not special[i]], dtype=np.int64)
        byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int64)
        return Vocabulary([sp.id_to_piece(int(i)).encode() for i in ids], np.array([sp.get_score(int(i)) for i in ids]), ids, byte_ids, algorithm)


@lru_cache(maxsize=2)
def _load(path: str, algorithm: str, changed: int, size: int) -> Vocabulary:
    return Vocabulary.read(path, algorithm)


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The ranges of ``count`` numbers from ``first`` on, one after the other."""
    upto = np.cumsum(count)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(first - (upto - count), count)


def occurrences(text: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Edges (start, piece) of every occurrence of every piece in ``text``, sorted by start, then length."""
    at = np.flatnonzero(((text & 0xC0) != 0x80) & (text != 0))
    padded = np.concatenate((text, np.zeros(len(vocabulary.levels) * WORD, np.uint8)))
    words = np.ndarray((len(padded) - WORD + 1,), ">u8", padded, strides=(1,))
    width, room = vocabulary.longest + 1, len(vocabulary.pieces)
    group, found = np.zeros(len(at), np.int64), [np.zeros(0, np.int64)]
    for k, (own, low, high, here) in enumerate(vocabulary.levels):
        word = words[at + k * WORD].astype(np.uint64)
        if k:
            # groups and words as one number
            distinct, word = np.unique(word, return_inverse=True)
            word += group * len(distinct)
            low, high = (own * len(distinct) + np.searchsorted(distinct, x, side=side) for x, side in ((low, "left"), (high, "right")))
            high -= 1
        order = np.argsort(word)
        word = word[order]
        first = np.searchsorted(word, low)
        count = np.maximum(np.searchsorted(word, high, side="right") - first, 0)
        n = len(here)
        start = at[order[_spread(first[:n], count[:n])]]
        found.append((start * width + np.repeat(vocabulary.lengths[here], count[:n])) * room + np.repeat(here, count[:n]))
        at, group = at[order[_spread(first[n:], count[n:])]], np.repeat(np.arange(len(own) - n), count[n:])
        if not len(at):
            break
    edges = np.sort(np.concatenate(found))
    code, piece = np.divmod(edges, room)
    return code // width, piece


def _merge_long(edges: np.ndarray, code: np.ndarray, score: np.ndarray, width: int) -> np.ndarray:
    """Bounds of the symbols of one unit that starts with the bounds ``edges``; ``code`` has start * width + length of its edges, sorted."""
    codes, scores, at = code.tolist(), score.tolist(), edges.tolist()
    n = len(at) - 1
    following, before, alive = list(range(1, n + 2)), list(range(-1, n)), [True] * n
    heap: list[tuple[float, int, int]] = []

    def offer(i: int, j: int) -> None:
        """The pair of the symbols from bound i to j and on to the next bound."""
        if i >= 0 and j < n:
            begin, end = at[i], at[following[j]]
            if end - begin < width:
                key = begin * width + end - begin
                k = bisect_left(codes, key)
                if k < len(codes) and codes[k] == key:
                    heapq.heappush(heap, (-scores[k], i, end))

    for i in range(n - 1):
        offer(i, i + 1)
    while heap:
        _, i, end = heapq.heappop(heap)
        # an offer holds as long as two whole symbols still end there
        if not alive[i] or following[i] >= n or at[following[following[i]]] != end:
            continue
        j = following[i]
        alive[j] = False
        following[i] = following[j]
        if following[i] < n:
            before[following[i]] = i
        offer(before[i], i)
        offer(i, following[i])
    return np.array([at[i] for i in range(n) if alive[i]] + [at[n]], dtype=np.int64)


def relax_bpe(text: np.ndarray, unit_starts: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ids (-1: no piece) of the symbols of all units; units are separated by zero bytes."""
    start, piece = occurrences(text, vocabulary)
    width = np.int64(vocabulary.longest + 1)
    code = start * width + vocabulary.lengths[piece]
    left = np.flatnonzero(((text & 0xC0) != 0x80) & (text != 0))
    unit = np.searchsorted(unit_starts, left, side="right") - 1
    stop = np.flatnonzero(text == 0)
    unit_end = stop[np.searchsorted(stop, unit_starts)]
    ends = np.append(left[1:], len(text))
    ends = np.minimum(ends, unit_end[unit])

    def edge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of the edge from a to b, or -1."""
        long = b - a >= width
        at = np.minimum(np.searchsorted(code, a * width + np.where(long, 0, b - a)), max(0, len(code) - 1))
        if not len(code):
            return np.full(len(a), -1)
        return np.where(~long & (code[at] == a * width + (b - a)), at, -1)

    done_left, done_end = [], []
    size = np.bincount(unit, minlength=len(unit_starts))
    for u in np.flatnonzero(size > LONG):
        own = slice(np.searchsorted(unit, u), np.searchsorted(unit, u, side="right"))
        a, b = np.searchsorted(start, [left[own][0], ends[own][-1]])
        merged = _merge_long(np.append(left[own], ends[own][-1]), code[a:b], vocabulary.scores[piece[a:b]], int(width))
        done_left.append(merged[:-1])
        done_end.append(merged[1:])
    short = size[unit] <= LONG
    left, ends = left[short], ends[short]
    size = size[(size > 0) & (size <= LONG)]
    rank = np.append(vocabulary.rank[piece], NONE)
    # of each symbol the rank of the piece that it and the next one of its unit make
    joint = np.full(len(left), NONE)
    pair = np.ones(len(left), dtype=bool)
    pair[np.cumsum(size) - 1] = False
    pair = np.flatnonzero(pair)
    joint[pair] = rank[edge(left[pair], ends[pair + 1])]
    while len(left):
        head = np.cumsum(size) - size
        # best pair of each unit: highest score, then leftmost
        best = np.minimum.reduceat((joint << 32) | np.arange(len(left)), head)
        busy = (best >> 32) < NONE
        take, head, last = best[busy] & 0xFFFFFFFF, head[busy], (head + size - 1)[busy]
        ends[take] = ends[take + 1]
        joint[take] = NONE
        before, after = take[take > head] - 1, take[take + 1 < last]
        changed = np.concatenate((before, after))
        joint[changed] = rank[edge(left[changed], ends[np.concatenate((before + 1, after + 2))])]
        keep = np.repeat(busy, size)
        done_left.append(left[~keep])
        done_end.append(ends[~keep])
        keep[take + 1] = False
        left, ends, joint, size = left[keep], ends[keep], joint[keep], size[busy] - 1
    left, ends = np.concatenate(done_left or [np.zeros(0, np.int64)]), np.concatenate(done_end or [np.zeros(0, np.int64)])
    order = np.argsort(left)
    left, ends = left[order], ends[order]
    e = edge(left, ends)
    return left, np.append(vocabulary.ids[piece], -1)[e]


def relax_unigram(text: np.ndarray, unit_starts: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """As ``relax_bpe``, by the best total score; an uncovered character costs ten below the least score."""
    start, piece = occurrences(text, vocabulary)
    left = np.flatnonzero(((text & 0xC0) != 0x80) & (text != 0))
    following = np.append(left[1:], len(text))
    stop = np.flatnonzero(text == 0)
    following = np.minimum(following, stop[np.searchsorted(stop, left)])
    unknown = float(vocabulary.scores.min()) - 10.0
    a = np.concatenate((start, left))
    b = np.concatenate((start + vocabulary.lengths[piece], following))
    value = np.concatenate((vocabulary.scores[piece], np.full(len(left), unknown)))
    ids = np.concatenate((vocabulary.ids[piece], np.full(len(left), -1)))
    single = np.isin(left, start[vocabulary.lengths[piece] == (following[np.searchsorted(left, start)] - start)])
    value[len(start) :][single] = -np.inf
    origin = unit_starts[np.searchsorted(unit_starts, a, side="right") - 1]
    step = b - origin
    best = np.full(len(text) + 1, -np.inf)
    came = np.full(len(text) + 1, -1)
    best[unit_starts] = 0.0
    order = np.argsort(step, kind="stable")
    cut = np.flatnonzero(np.diff(step[order])) + 1
    for rows in np.split(order, cut):
        total = best[a[rows]] + value[rows]
        pick = rows[np.lexsort((a[rows], -total, b[rows]))]
        head = np.concatenate(([True], b[pick][1:] != b[pick][:-1])) if len(pick) else np.zeros(0, bool)
        pick = pick[head]
        gain = best[a[pick]] + value[pick]
        better = gain > best[b[pick]]
        best[b[pick][better]], came[b[pick][better]] = gain[better], pick[better]
    out_left, out_id = [], []
    at = stop[np.searchsorted(stop, unit_starts)]
    at = at[at > unit_starts]
    while len(at):
        e = came[at]
        out_left.append(a[e])
        out_id.append(ids[e])
        at = a[e]
        at = at[came[at] >= 0]
    left = np.concatenate(out_left or [np.zeros(0, np.int64)])
    order = np.argsort(left)
    return left[order], np.concatenate(out_id or [np.zeros(0, np.int64)])[order]


class Encoder:
    """Encodes blocks; remembers units as ranges of one array of ids."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.first = self.lengths = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def learn(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each unit, and all ids."""
        size = ends - starts
        own = np.cumsum(size + 1) - (size + 1)
        body = buf[_spread(starts, size)]
        body[body == 0] = 0xF8
        text = np.zeros(int(size.sum()) + len(size), np.uint8)
        text[_spread(own, size)] = body
        relax = relax_bpe if self.v.algorithm == "bpe" else relax_unigram
        left, ids = relax(text, own, self.v)
        n = np.ones(len(left), np.int64)
        lost = np.flatnonzero(ids < 0)
        if len(lost):
            # characters without a piece: one id a byte, and a blank is U+2581
            stop = np.flatnonzero(text == 0)
            end = np.minimum(np.append(left[1:], len(text))[lost], stop[np.searchsorted(stop, left[lost])])
            more = np.where(text[left[lost]] == 0x20, len(BLANK) - 1, 0)
            n[lost] = end - left[lost] + more
            step = _spread(np.zeros(len(lost), np.int64), n[lost])
            at, more = np.repeat(left[lost], n[lost]), np.repeat(more, n[lost])
            byte = np.where(step < more + (more > 0), np.frombuffer(BLANK, np.uint8)[step % len(BLANK)], text[np.maximum(at, at + step - more)])
            at = np.repeat(ids < 0, n)
            ids = np.repeat(ids, n)
            ids[at] = self.v.byte_ids[np.where(byte == 0xF8, 0, byte)]
        unit = np.repeat(np.arange(len(size)), size + 1)[left]
        return np.bincount(unit, weights=n, minlength=len(size)).astype(np.int64), ids.astype(np.int32)

    def __call__(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts and offsets by text; every text starts with a blank that the caller has added."""
        if len(self.known) > REMEMBERED:
            self.forget()
        starts, ptr = self.units(buf, offs)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        ends = np.append(starts[1:], len(buf))
        hashes = byte_hasher(buf).of(starts, ends)
        order = np.argsort(hashes)
        head = np.ones(len(order), dtype=bool)
        head[1:] = hashes[order[1:]] != hashes[order[:-1]]
        one = order[head]
        distinct = hashes[one]
        place = np.searchsorted(self.known, distinct)
        inside = place < len(self.known)
        new = ~inside
        new[inside] = self.known[place[inside]] != distinct[inside]
        if new.any():
            n, ids = self.learn(buf, starts[one[new]], ends[one[new]])
            self.first = np.insert(self.first, place[new], len(self.ids) + np.cumsum(n) - n)
            self.lengths = np.insert(self.lengths, place[new], n)
            self.known = np.insert(self.known, place[new], distinct[new])
            self.ids = np.concatenate((self.ids, ids))
            place += np.cumsum(new) - new
        number = np.empty(len(order), np.int64)
        number[order] = place[np.cumsum(head) - 1]
        n = self.lengths[number]
        upto = np.concatenate(([0], np.cumsum(n)))
        return self.ids[_spread(self.first[number], n)], upto[ptr]

    def units(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        blank, alone = buf == 0x20, self.v.alone[buf]
        cut = np.zeros(len(buf) + 1, dtype=bool)
        cut[: len(buf)] = alone | blank
        cut[1 : len(buf)] &= alone[1:] | ~blank[:-1]
        cut[1:] |= np.append(alone, False)[: len(buf)]
        cut[offs] = True
        starts = np.flatnonzero(cut[: len(buf)])
        return starts, np.searchsorted(starts, offs)


def _with_blank(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A blank in front of every text that is not empty; U+2581 becomes a blank."""
    full = (offs[1:] > offs[:-1]).astype(np.int64)
    new_offs = offs + np.concatenate(([0], np.cumsum(full)))
    out = np.full(new_offs[-1], 0x20, dtype=np.uint8)
    inner = np.ones(len(out), dtype=bool)
    inner[new_offs[:-1][full == 1]] = False
    out[inner] = buf
    mark = np.flatnonzero(out[:-2] == 0xE2) if len(out) > 2 else np.zeros(0, np.int64)
    mark = mark[(out[mark + 1] == 0x96) & (out[mark + 2] == 0x81)]
    if len(mark):
        keep = np.ones(len(out), dtype=bool)
        out[mark] = 0x20
        keep[mark + 1] = keep[mark + 2] = False
        upto = np.concatenate(([0], np.cumsum(keep)))
        out, new_offs = out[keep], upto[new_offs]
    return out, new_offs


def _encode(batches: Iterator[pa.RecordBatch], model: str, algorithm: str) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(Vocabulary.load(model, algorithm))
    for batch in batches:
        for block in blocks(batch.column(1)):
            ids, offs = encoder(*_with_blank(block.buf, block.offs))
            lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids), mask=pa.array(~block.valid))
            part = [batch.column(i).slice(block.first, len(block)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([part[0], lists, part[1]], names=["doc_id", "ids", "text"])


def _decode(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    v = Vocabulary.load(model)
    for batch in batches:
        lists = batch.column(1)
        valid = np.asarray(lists.is_valid())
        n = np.where(valid, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
        ids = lists.flatten().to_numpy(zero_copy_only=False).astype("<i4", copy=False)
        ptr = np.concatenate(([0], np.cumsum(n)))
        out, first = [], 0
        while first < len(lists):
            last = max(first + 1, int(np.searchsorted(ptr, ptr[first] + DECODED, side="right")) - 1)
            own = ids[ptr[first] : ptr[last]]
            size = v.out_offs[own + 1] - v.out_offs[own]
            raw = v.out_bytes[_spread(v.out_offs[own], size)].tobytes()
            cut = np.concatenate(([0], np.cumsum(size)))[ptr[first : last + 1] - ptr[first]].tolist()
            for i, a, b in zip(range(first, last), cut[:-1], cut[1:], strict=True):
                out.append(raw[a + (raw[a : a + 1] == b" " and a < b) : b].decode("utf-8", "replace") if valid[i] else None)
            first = last
        raw, cut = memoryview(ids.tobytes()), (4 * ptr).tolist()
        sums = [hashlib.sha256(raw[a:b]).hexdigest() if there else None for a, b, there in zip(cut[:-1], cut[1:], valid.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), lists, batch.column(2), pa.array(out, pa.string()), pa.array(sums, pa.string())], names=["doc_id", "ids", "text", "decoded", "ids_sha256"])


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, algorithm: str = "bpe") -> DataFrame:
    """(doc_id, ids, text) of every row."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _encode(it, model, algorithm), "doc_id long, ids array<int>, text string")


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids, text, decoded, ids_sha256) of (doc_id, ids, text) rows; the hash is over 32-bit little-endian ids."""
    return rows.select("doc_id", "ids", "text").mapInArrow(lambda it: _decode(it, model), "doc_id long, ids array<int>, text string, decoded string, ids_sha256 string")
