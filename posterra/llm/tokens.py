"""Token counts that survive edits: a tree over each document's pre-token segments.

A text is cut before every space (0x20) that a character other than white space follows, and
between full-width punctuation and an ideograph, whatever the script. The pre-token pattern
never puts such a place inside a pre-token, nor looks beyond it from the left, so the tokens
of a text are those of its segments, one after the other. Segments are the leaves of a sum tree
of (characters, tokens). An edit finds its first and last leaf by descending the tree,
re-encodes the text of those leaves (and of the one before, where the edit removes the
space that ended it), and updates the sums on the paths to the root.

For whole tables the segments of a block of texts are hashed together, each distinct one is
encoded once and kept (up to ``REMEMBERED`` per worker, then forgotten; that changes speed,
never counts), and the leaves of all texts are looked up at once.

Cases: a null text has null counts, an empty one zero; edits outside the text are clipped
to it; edits of a text apply one after the other, each to the result of those before; a
null or empty list of edits leaves the counts; an edit that is null or lacks its start or end
is none; one without a replacement deletes; equal rows get equal rows; columns other
than the named ones pass through or are ignored; an empty table gives no rows. Special
tokens' strings count as ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblocks import Block, blocks, byte_hasher

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern that belongs to the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REMEMBERED = 1 << 20
#: First bytes of characters, without those of white space and those that more bytes must tell from it.
_SOLID = np.ones(256, dtype=bool)
_SOLID[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = False
_SOLID[0x80:0xC0] = False


#: Full-width marks that end a segment before an ideograph: U+3001, U+3002, U+FF01, U+FF0C, U+FF1A, U+FF1B, U+FF1F.
_MARKS = frozenset("\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f")


def encoder(ranks: str = RANKS, pattern: str = PATTERN) -> Callable[[str], list[int]]:
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary


def segment_starts(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of all segments of a block, and the first segment of each text (one more at the end)."""
    n = len(buf)
    b = np.concatenate((buf, np.zeros(4, np.uint8)))
    one, two, three = b[1 : n + 1], b[2 : n + 2], b[3 : n + 3]
    solid = _SOLID[one] & (one != 0)
    solid |= (one == 0xC2) & (two != 0x85) & (two != 0xA0)
    # U+1680, U+2000 to U+206F and U+3000 are white space or near it
    solid |= ((one == 0xE1) & (two != 0x9A)) | ((one == 0xE2) & (two > 0x81)) | ((one == 0xE3) & ((two != 0x80) | (three != 0x80)))
    cut = np.zeros(n + 1, dtype=bool)
    cut[:n] = (buf == 0x20) & solid
    # the bytes of ``_MARKS`` before those of U+4E00 to U+9FFF
    mark = ((buf == 0xE3) & (one == 0x80) & ((two == 0x81) | (two == 0x82))) | ((buf == 0xEF) & (one == 0xBC) & np.isin(two, (0x81, 0x8C, 0x9A, 0x9B, 0x9F)))
    after = np.flatnonzero(mark) + 3
    after = after[after < n]
    cut[after[((b[after] == 0xE4) & (b[after + 1] >= 0xB8)) | ((b[after] > 0xE4) & (b[after] <= 0xE9))]] = True
    full = offs[:-1][offs[1:] > offs[:-1]]
    # what the next text begins with ends no segment of this one
    cut[offs[1:][offs[1:] > offs[:-1]] - 1] &= buf[offs[1:][offs[1:] > offs[:-1]] - 1] != 0x20
    cut[full] = True
    starts = np.flatnonzero(cut[:n])
    return starts, np.searchsorted(starts, offs)


def _begins(before: str, text: str) -> bool:
    """Whether ``text`` begins a segment after ``before``."""
    if text[:1] == " ":
        return len(text) > 1 and not text[1].isspace() and not 0x2000 <= ord(text[1]) <= 0x206F and text[1] != "\0"
    return before[-1:] in _MARKS and "\u4e00" <= text[:1] <= "\u9fff"


class TokenTree:
    """Sums of characters and tokens over the segments of one text."""

    def __init__(self, leaves: list[str], tokens: np.ndarray, encode: Callable[[str], list[int]]):
        self.encode, self.leaves = encode, leaves
        size = 1 << max(0, len(leaves) - 1).bit_length()
        self.size = size
        self.chars, self.tokens = np.zeros(2 * size, np.int64), np.zeros(2 * size, np.int64)
        self.chars[size : size + len(leaves)] = [len(x) for x in leaves]
        self.tokens[size : size + len(leaves)] = tokens
        for a in (self.chars, self.tokens):
            level = size
            while level > 1:
                a[level // 2 : level] = a[level : 2 * level : 2] + a[level + 1 : 2 * level : 2]
                level //= 2
        self.encoded_chars = 0

    @staticmethod
    def of(text: str, encode: Callable[[str], list[int]]) -> TokenTree:
        leaves = split(text)
        return TokenTree(leaves, np.array([len(encode(x)) for x in leaves], dtype=np.int64), encode)

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def text(self) -> str:
        return "".join(self.leaves)

    def _leaf(self, at: int) -> tuple[int, int]:
        """Leaf that holds character ``at`` (the last non-empty one for the end), and its first character."""
        at = min(at, int(self.chars[1]) - 1)
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if before + self.chars[node] <= at:
                before += int(self.chars[node])
                node += 1
        return node - self.size, before

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        node = leaf + self.size
        self.chars[node], self.tokens[node] = len(text), tokens
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def edit(self, start: int, end: int, replacement: str) -> int:
        """Replace characters start:end; returns the new number of tokens."""
        n = int(self.chars[1])
        start = max(0, min(start, n))
        end = max(start, min(end, n))
        if not self.leaves or n == 0:
            if replacement:
                self._put(0, len(self.leaves), replacement)
            return self.total
        first, at = self._leaf(start)
        last, last_at = self._leaf(max(start, end - 1))
        old = "".join(self.leaves[first : last + 1])
        new = old[: start - at] + replacement + old[end - at :]
        while first > 0 and not _begins(self.leaves[first - 1], new):
            first -= 1
            new = self.leaves[first] + new
        # what follows began a segment after a mark that may be gone
        while last + 1 < len(self.leaves) and not _begins(new, self.leaves[last + 1]):
            last += 1
            new += self.leaves[last]
        self._put(first, last + 1, new)
        return self.total

    def _put(self, first: int, stop: int, new: str) -> None:
        """Leaves first:stop become the segments of ``new``; where those are more, the sums above are built anew, but nothing else is encoded."""
        pieces = split(new)
        tokens = [len(self.encode(x)) for x in pieces]
        self.encoded_chars += len(new)
        if len(pieces) <= stop - first:
            for leaf in range(first, stop):
                at = leaf - first
                if at < len(pieces) or self.leaves[leaf]:
                    self._set(leaf, *((pieces[at], tokens[at]) if at < len(pieces) else ("", 0)))
            return
        size, encoded = self.size, self.encoded_chars
        kept = self.tokens[size : size + len(self.leaves)]
        self.__init__([*self.leaves[:first], *pieces, *self.leaves[stop:]], np.concatenate((kept[:first], tokens, kept[stop:])).astype(np.int64), self.encode)
        self.encoded_chars = encoded


def split(text: str) -> list[str]:
    if not text:
        return []
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    starts, _ = segment_starts(data, np.array([0, len(data)]))
    raw = data.tobytes()
    return [raw[a:b].decode("utf-8") for a, b in zip(starts, [*starts[1:], len(raw)], strict=True)]


class Counter:
    """Token counts of all segments of a block."""

    def __init__(self, encode: Callable[[str], list[int]]):
        self.encode = encode
        self.known: dict[int, int] = {}

    def __call__(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, ptr = segment_starts(block.buf, block.offs)
        ends = np.append(starts[1:], len(block.buf))
        hashes = byte_hasher(block.buf).of(starts, ends)
        distinct, one, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        counts = np.zeros(len(distinct), np.int64)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for i, (h, at) in enumerate(zip(distinct.tolist(), one.tolist(), strict=True)):
            got = self.known.get(h)
            if got is None:
                got = self.known[h] = len(self.encode(block.buf[starts[at] : ends[at]].tobytes().decode("utf-8", "replace")))
            counts[i] = got
        return starts, ptr, counts[inverse]


def _count(batches: Iterator[pa.RecordBatch], ranks: str, pattern: str) -> Iterator[pa.RecordBatch]:
    encode = encoder(ranks, pattern)
    counter = Counter(encode)
    for batch in batches:
        edits = batch.column(2).to_pylist()
        out = [[], [], [], []]
        for block in blocks(batch.column(1)):
            starts, ptr, tokens = counter(block)
            sums = np.concatenate(([0], np.cumsum(tokens)))
            for i in range(len(block)):
                if not block.valid[i]:
                    for column in out:
                        column.append(None)
                    continue
                a, b = ptr[i], ptr[i + 1]
                total = int(sums[b] - sums[a])
                after, encoded = total, 0
                todo = edits[block.first + i]
                if todo:
                    raw = block.buf[block.offs[i] : block.offs[i + 1]].tobytes()
                    edges = [*(starts[a:b] - block.offs[i]).tolist(), len(raw)]
                    tree = TokenTree([raw[x:y].decode("utf-8", "replace") for x, y in zip(edges, edges[1:], strict=False)], tokens[a:b], encode)
                    for e in todo:
                        if e is not None and e["start"] is not None and e["end"] is not None:
                            tree.edit(e["start"], e["end"], e["replacement"] or "")
                    after, encoded = tree.total, tree.encoded_chars
                for column, value in zip(out, (int(b - a), total, after, encoded), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in out)], names=["doc_id", "n_segments", "n_tokens", "n_tokens_edited", "n_reencoded"])


EDITS = "array<struct<start:int,end:int,replacement:string>>"


def count(docs: DataFrame, key: str = "doc_id", text: str = "text", edits=None, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_segments, n_tokens, n_tokens_edited, n_reencoded); ``edits`` is a column of (start, end, replacement) arrays."""
    todo = F.lit(None).cast(EDITS) if edits is None else edits.cast(EDITS)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), todo.alias("edits"))
    return rows.mapInArrow(lambda it: _count(it, ranks, pattern), "doc_id long, n_segments long, n_tokens long, n_tokens_edited long, n_reencoded long")


TREES = "doc_id long, text string, chars array<int>, tokens array<int>, n_tokens long, n_reencoded long"


def _planted(batches: Iterator[pa.RecordBatch], ranks: str, pattern: str) -> Iterator[pa.RecordBatch]:
    counter = Counter(encoder(ranks, pattern))
    for batch in batches:
        for block in blocks(batch.column(1)):
            starts, ptr, tokens = counter(block)
            lead = np.concatenate(([0], np.cumsum((block.buf & 0xC0) != 0x80)))
            chars = np.diff(lead[np.append(starts, len(block.buf))])
            sums = np.concatenate(([0], np.cumsum(tokens)))
            lists = [pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(x.astype(np.int32)), mask=pa.array(~block.valid)) for x in (chars, tokens)]
            own = [batch.column(i).slice(block.first, len(block)) for i in (0, 1)]
            total = pa.array(sums[ptr[1:]] - sums[ptr[:-1]], mask=~block.valid)
            yield pa.RecordBatch.from_arrays([*own, *lists, total, pa.array(np.where(block.valid, np.diff(lead[block.offs]), 0))], names=[x.split()[0] for x in TREES.split(", ")])


def _grown(batches: Iterator[pa.RecordBatch], ranks: str, pattern: str) -> Iterator[pa.RecordBatch]:
    encode = encoder(ranks, pattern)
    names = [x.split()[0] for x in TREES.split(", ")]
    for batch in batches:
        out = []
        for key, text, chars, tokens, edits in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if text is None:
                out.append((key, None, None, None, None, 0))
                continue
            edges = np.concatenate(([0], np.cumsum(chars, dtype=np.int64))).tolist()
            tree = TokenTree([text[a:b] for a, b in zip(edges, edges[1:], strict=False)], np.array(tokens, dtype=np.int64), encode)
            for e in edits or ():
                if e is not None and e["start"] is not None and e["end"] is not None:
                    tree.edit(e["start"], e["end"], e["replacement"] or "")
            kept = [i for i, leaf in enumerate(tree.leaves) if leaf]
            out.append((key, tree.text(), [len(tree.leaves[i]) for i in kept], [int(tree.tokens[tree.size + i]) for i in kept], tree.total, tree.encoded_chars))
        columns = list(zip(*out, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def plant(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, text, chars, tokens, n_tokens, n_reencoded): a segment tree's leaves for every document, to be kept as a table; null texts have null leaves."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _planted(it, ranks, pattern), TREES)


def grow(trees: DataFrame, edits, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """The kept trees after ``edits``: leaves that no edit touches keep their counts, ``n_reencoded`` characters were encoded anew."""
    rows = trees.select("doc_id", "text", "chars", "tokens", edits.cast(EDITS).alias("edits"))
    return rows.mapInArrow(lambda it: _grown(it, ranks, pattern), TREES)
