"""Language identification with bit-sliced Bloom filters of character n-grams.

Training counts character n-grams of every training text by language. An n-gram
belongs to a language if at least ``LEAST_SHARE`` of the language's n-grams are it and
its share is at least ``LEAST_RATIO`` of its largest share in any language. The first
condition bounds a language's filter to ``1 / LEAST_SHARE`` entries whatever the
corpus. The filters of 64 languages lie side by side as the bits of one array of
64-bit slices, so ``HASHES`` look-ups return every language that holds an n-gram.

A text's n-grams give a popcount per language; the false positive rate ``f`` of that
language's filter is removed, ``(hits / n - f) / (1 - f)``, and the largest estimate
decides (ties: the smaller name). ``score`` is that estimate, between 0 and 1.

Cases: a null text or one without a letter gives ``und`` and score 0; rows with a null
language are never learned from but are predicted; a null key is never held out; equal
rows get equal rows; an empty training set gives ``und``; columns other than the named
ones are ignored, and language, source and key are no inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import checkpointed
from .textblocks import Block, Characters, blocks, count_grams, has_letter, mix

GRAM = 4
LEAST_SHARE = 2e-5
LEAST_RATIO = 0.25
HASHES = 4
BITS_PER_ENTRY = 12
FOLDS = 5
UNKNOWN = "und"


@dataclass
class SlicedFilters:
    """``slices[w][j]`` bit b: position j of the Bloom filter of language ``64 * w + b``."""

    languages: list[str]
    slices: np.ndarray
    false_positive: np.ndarray

    @staticmethod
    def build(languages: list[str], grams: np.ndarray, owner: np.ndarray) -> SlicedFilters:
        most = int(np.bincount(owner, minlength=1).max()) if len(owner) else 1
        size = 1 << max(10, int(most * BITS_PER_ENTRY - 1).bit_length())
        slices = np.zeros((max(1, -(-len(languages) // 64)), size), dtype=np.uint64)
        for position in SlicedFilters.positions(grams, size):
            np.bitwise_or.at(slices, (owner // 64, position), np.uint64(1) << (owner % 64).astype(np.uint64))
        full = np.array([((slices[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
        return SlicedFilters(languages, slices, full**HASHES)

    @staticmethod
    def positions(grams: np.ndarray, size: int) -> Iterator[np.ndarray]:
        a = mix(grams + np.uint64(0x51ED270B))
        b = (a >> np.uint64(32)) | np.uint64(1)
        for i in range(HASHES):
            yield ((a + np.uint64(i) * b) & np.uint64(size - 1)).astype(np.int64)

    def holders(self, grams: np.ndarray, word: int) -> np.ndarray:
        """Bit mask of the languages 64 * word .. 64 * word + 63 that hold each n-gram."""
        out = None
        for position in self.positions(grams, self.slices.shape[1]):
            got = self.slices[word][position]
            out = got if out is None else out & got
        return out


def held_out(key: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", gram: int = GRAM) -> SlicedFilters:
    """Learn from the rows where ``train`` holds; at most ``1 / LEAST_SHARE`` rows a language reach the driver."""
    rows = docs.where(train & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("grp"), F.col(text).cast("string").alias("text"))
    counts = checkpointed(rows.mapInArrow(lambda it: count_grams(it, gram), "grp string, gram long, cnt long").groupBy("grp", "gram").agg(F.sum("cnt").alias("cnt")))
    total = counts.groupBy("grp").agg(F.sum("cnt").alias("total"))
    share = counts.join(F.broadcast(total), "grp").select("grp", "gram", (F.col("cnt") / F.col("total")).alias("share")).where(F.col("share") >= LEAST_SHARE)
    most = share.groupBy("gram").agg(F.max("share").alias("most"))
    kept = share.join(most, "gram").where(F.col("share") >= LEAST_RATIO * F.col("most")).select("grp", "gram").toArrow()
    languages = sorted(row.grp for row in total.select("grp").collect())
    number = {name: i for i, name in enumerate(languages)}
    owner = np.array([number[x] for x in kept.column("grp").to_pylist()], dtype=np.int64)
    return SlicedFilters.build(languages, kept.column("gram").to_numpy().astype(np.int64).view(np.uint64), owner)


def classify(filters: SlicedFilters, block: Block, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Number of the predicted language of each text (-1: unknown) and its score."""
    lettered = has_letter(block)
    grams, doc = Characters.of(block).grams(gram)
    n = np.bincount(doc, minlength=len(block))
    edge = np.searchsorted(doc, np.arange(len(block) + 1))
    estimate = np.zeros((len(filters.languages), len(block)))
    for word in range(filters.slices.shape[0]):
        mask = filters.holders(grams, word)
        for i in range(64 * word, min(64 * word + 64, len(filters.languages))):
            hits = np.zeros(len(grams) + 1, dtype=np.int64)
            np.cumsum((mask >> np.uint64(i % 64)) & np.uint64(1), out=hits[1:], dtype=np.int64)
            f = filters.false_positive[i]
            estimate[i] = ((hits[edge[1:]] - hits[edge[:-1]]) / np.maximum(n, 1) - f) / max(1e-9, 1 - f)
    if not len(filters.languages):
        return np.full(len(block), -1), np.zeros(len(block))
    best = estimate.argmax(axis=0)
    score = np.clip(estimate[best, np.arange(len(block))], 0.0, 1.0)
    best[~lettered] = -1
    score[~lettered] = 0.0
    return best, score


def _predict(batches: Iterator[pa.RecordBatch], filters) -> Iterator[pa.RecordBatch]:
    model = filters.value
    names = np.array([*model.languages, UNKNOWN], dtype=object)
    for batch in batches:
        got = [classify(model, block) for block in blocks(batch.column(2))]
        if got:
            best, score = (np.concatenate(x) for x in zip(*got, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names[best], pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"]
            )


def predict(docs: DataFrame, filters: SlicedFilters, key: str = "doc_id", text: str = "text", folds: int = FOLDS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), held_out(F.col(key), folds).alias("held_out"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _predict(it, shared), "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from the rows that are not held out, predict every row."""
    return predict(docs, fit(docs, ~held_out(F.col(key)) & F.col(key).isNotNull(), text, lang), key, text)
