"""Quality rules: base counts and an n-gram perplexity band per language.

Two passes read the texts. The first counts character n-grams (exact, merged as sorted arrays
within each task, then summed by Spark) by language and fold; a text's fold comes from its hash, so
equal texts share one. From the counts Spark derives an interpolated modified Kneser-Ney model for each fold,
from the texts of all other folds: no text is judged by a model that saw it, and every text is
counted towards some model. Every n-gram that a fold's own texts have gets its probability under that fold's model,
lower orders included, so that scoring is one look-up: it is held under a 64-bit hash of language, fold and n-gram, and looked up by the
whole hash (two of ``n`` grams share a hash with probability ``n ** 2 / 2 ** 65``). The second pass scores every text
and counts the base rules. Symbols are UTF-16 units, by case, digits and blanks alike. A model of more than ``ENTRIES`` n-grams is dealt by hash
into parts of about that many; the texts are read once for each part, of which only
one is gathered and broadcast at a time, and what the parts add to a text is summed. The band
of a language is its median log2 perplexity plus and minus a multiple of the
median absolute deviation, narrower below (text that says the same over and over) than above
(noise); each distinct text counts once, so copies don't move it. A language of fewer than ``LEAST_TEXTS`` distinct texts
that pass the base rules has no band: a few texts say nothing of what is usual.

Cases: a null or empty text has no words and fails the base rules; a null language
is a language of its own; a text with fewer characters than the model's order has
no perplexity and keeps the verdict of the base rules; equal rows get equal rows;
columns other than the named ones are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import checkpointed
from .textblocks import SYMBOL_BITS, Block, Characters, Words, blocks, byte_hasher, count_grams, mix

ORDER = 4
#: Parts of the texts, each of which is judged by a model of the others.
FOLDS = 2
#: Distinct texts of a language from which on it has a band.
LEAST_TEXTS = 20
#: N-grams of one part of the model: 12 bytes each on the driver, at most 48 in a task's table.
ENTRIES = 1 << 22
#: Half width of a band in scaled median absolute deviations, and its least values in bits, below and above.
BAND = 12.0
LEAST_BAND = (0.75, 2.0)
_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(b"#*$%&|<>")] = True


# --- the language model -------------------------------------------------------------------------


def kneser_ney(counts: DataFrame, order: int = ORDER, models: tuple[str, ...] = ("cnt",), keep: tuple[str, ...] = ()) -> list[DataFrame]:
    """(grp, gram, ctx, p0, p1, ..., gamma0, gamma1, ...) of each order, from 1, of interpolated modified Kneser-Ney models.

    ``counts`` has (grp, gram) of the highest order and a column of counts for each of ``models``, which may be 0. Lower
    orders count the distinct symbols to the left. ``p`` has the lower orders in it; ``gamma`` is the weight of the
    lower order after the context ``ctx``, 1 if the model never saw that. Each order is cut off from the plan of those
    before it, which would else be planned again with every order. The last has the columns ``keep`` too.
    """
    mask = lambda k: (1 << (SYMBOL_BITS * k)) - 1
    own = range(len(models))
    level = {order: counts.select("grp", "gram", *[F.col(m).cast("double").alias(f"c{i}") for i, m in enumerate(models)], *keep)}
    for k in range(order - 1, 0, -1):
        shorter = level[k + 1].groupBy("grp", F.col("gram").bitwiseAND(F.lit(mask(k))).alias("gram"))
        level[k] = checkpointed(shorter.agg(*[F.count_if(F.col(f"c{i}") > 0).cast("double").alias(f"c{i}") for i in own]))
    few = [F.count_if(F.col(f"c{i}") == n).cast("double").alias(f"n{i}_{n}") for i in own for n in (1, 2, 3, 4)]
    of = reduce(DataFrame.unionByName, [level[k].select("grp", F.lit(k).alias("k"), *[f"c{i}" for i in own]) for k in level]).groupBy("grp", "k").agg(*few)

    def discount(i: int, n: int):
        one, two = F.col(f"n{i}_1"), F.col(f"n{i}_2")
        y = F.coalesce(F.try_divide(one, one + 2 * two), F.lit(0.5))
        value = n - (n + 1) * y * F.try_divide(F.col(f"n{i}_{n + 1}"), F.col(f"n{i}_{n}"))
        return F.greatest(F.lit(0.1), F.least(F.lit(float(n)), F.coalesce(value, F.lit(0.5 * n)))).alias(f"d{i}_{n}")

    # one row a language and order
    of = checkpointed(of.select("grp", "k", *[discount(i, n) for i in own for n in (1, 2, 3)]))
    out: list[DataFrame] = []
    for k in range(1, order + 1):
        t = level[k].join(F.broadcast(of.where(F.col("k") == k)), "grp")
        d = [F.when(F.col(f"c{i}") == 0, 0.0).when(F.col(f"c{i}") == 1, F.col(f"d{i}_1")).when(F.col(f"c{i}") == 2, F.col(f"d{i}_2")).otherwise(F.col(f"d{i}_3")).alias(f"d{i}") for i in own]
        more = keep if k == order else ()
        t = t.select("grp", "gram", *[f"c{i}" for i in own], *d, F.shiftrightunsigned("gram", SYMBOL_BITS).alias("ctx"), *more)
        # a context has at most as many rows as there are symbols
        context = Window.partitionBy("grp", "ctx")
        t = t.withColumns({f"tot{i}": F.sum(f"c{i}").over(context) for i in own} | {f"held{i}": F.sum(f"d{i}").over(context) for i in own})
        if k == 1:
            t = t.withColumns({f"low{i}": F.lit(1.0 / (1 << SYMBOL_BITS)) for i in own})
        else:
            lower = out[-1].select("grp", F.col("gram").alias("suffix"), *[F.col(f"p{i}").alias(f"low{i}") for i in own])
            t = t.withColumn("suffix", F.col("gram").bitwiseAND(F.lit(mask(k - 1)))).join(lower, ["grp", "suffix"])
        gamma = {i: F.when(F.col(f"tot{i}") > 0, F.col(f"held{i}") / F.col(f"tot{i}")).otherwise(1.0) for i in own}
        p = [(F.when(F.col(f"tot{i}") > 0, F.greatest(F.col(f"c{i}") - F.col(f"d{i}"), F.lit(0.0)) / F.col(f"tot{i}")).otherwise(0.0) + gamma[i] * F.col(f"low{i}")).alias(f"p{i}") for i in own]
        out.append(checkpointed(t.select("grp", "gram", "ctx", *p, *[gamma[i].alias(f"gamma{i}") for i in own], *more)))
    return out


def gram_keys(grams: np.ndarray, group_hash: np.ndarray) -> np.ndarray:
    """64-bit hash of each packed gram of a language."""
    return mix(grams ^ mix(group_hash.view(np.uint64)))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language hash, gram, logp) to (key, logp)."""
    for b in batches:
        g, gram = (b.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(2))
        yield pa.RecordBatch.from_arrays([pa.array(gram_keys(gram, g).view(np.int64)), b.column(2)], names=["key", "logp"])


def fold_of(text, folds: int):
    """The part of the texts that a text belongs to."""
    return F.pmod(F.xxhash64(text), F.lit(folds)).cast("int")


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER, folds: int = FOLDS) -> DataFrame:
    """(key, logp) of every n-gram of the highest order that a fold's texts have, under the model of all other folds."""
    body = F.col(text).cast("string")
    source = docs.select(F.concat(fold_of(body, folds).cast("string"), F.lit(":"), F.coalesce(F.col(lang).cast("string"), F.lit(""))).alias("part"), body.alias("text"))
    counted = source.mapInArrow(lambda it: count_grams(it, order), "grp string, gram long, cnt long")
    fold, grp = F.substring_index("grp", ":", 1).cast("int"), F.expr("substring(grp, instr(grp, ':') + 1)")
    counted = counted.groupBy(grp.alias("grp"), "gram").agg(*[F.coalesce(F.sum(F.when(fold == i, F.col("cnt"))), F.lit(0)).alias(f"own{i}") for i in range(folds)])
    others = {f"others{i}": reduce(lambda a, b: a + b, [F.col(f"own{j}") for j in range(folds) if j != i], F.lit(0)) for i in range(folds)}
    own = tuple(f"own{i}" for i in range(folds))
    model = kneser_ney(checkpointed(counted).withColumns(others), order, tuple(others), own)[-1]
    each = F.array(*[F.struct(F.xxhash64("grp", F.lit(i)).alias("g"), F.col("gram"), F.log2(f"p{i}").cast("float").alias("logp"), F.col(f"own{i}").alias("own")) for i in range(folds)])
    rows = model.select(F.inline(each)).where("own > 0").select("g", "gram", "logp")
    return checkpointed(rows.mapInArrow(_keyed, "key long, logp float"))


@dataclass
class Part:
    """The n-grams whose key is ``number`` modulo ``parts``."""

    keys: np.ndarray
    logp: np.ndarray
    number: int = 0
    parts: int = 1
    order: int = ORDER


def parts(model: DataFrame, order: int = ORDER, entries: int = ENTRIES) -> Iterator[Part]:
    """The model in parts of about ``entries`` n-grams, gathered one after the other."""
    n = max(1, -(-model.count() // entries))
    for i in range(n):
        got = model.where(F.pmod("key", F.lit(n).cast("long")) == i).toArrow()
        yield Part(got.column("key").to_numpy().view(np.uint64), got.column("logp").to_numpy(), i, n, order)


class Table:
    """Values by 64-bit hash, in open addressing at most half full; what is absent is NaN."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(1, int(2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        home = self._home(keys)
        order = np.argsort(home, kind="stable")
        at = np.arange(len(keys))
        place = np.maximum.accumulate(home[order] - at) + at
        size = max(1 << bits, int(place[-1]) + 1 if len(place) else 0) + 1
        self.keys, self.values = np.zeros(size, dtype=np.uint64), np.full(size, np.nan, dtype=np.float32)
        self.keys[place], self.values[place] = keys[order], values[order]

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        out = self.values[at]
        left = np.flatnonzero((self.keys[at] != keys) & ~np.isnan(out))
        at = at[left]
        while len(left):
            at += 1
            value = self.values[at]
            out[left] = value
            on = (self.keys[at] != keys[left]) & ~np.isnan(value)
            left, at = left[on], at[on]
        return out


class Scorer:
    """Sums of log2 probabilities of blocks under a part of the model."""

    def __init__(self, part: Part):
        self.part, self.table = part, Table(part.keys, part.logp)

    def __call__(self, block: Block, group_hash: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log2 probability of those of each text's n-grams that are in the part, and the number of all."""
        grams, doc = Characters.of(block).grams(self.part.order)
        count = np.bincount(doc, minlength=len(block))
        keys = gram_keys(grams, group_hash[doc])
        if self.part.parts > 1:
            own = keys.view(np.int64) % self.part.parts == self.part.number
            keys, doc = keys[own], doc[own]
        score = self.table(keys)
        if np.isnan(score).any():
            raise ValueError("a text has an n-gram that was not counted: the documents changed between two reads")
        return np.bincount(doc, weights=score, minlength=len(block)).astype(np.float64), count


# --- base rules ---------------------------------------------------------------------------------


def base_counts(block: Block) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n, buf, offs = len(block), block.buf, block.offs
    words = block.words()

    def per_text(flags: np.ndarray) -> np.ndarray:
        upto = np.zeros(len(buf) + 1, dtype=np.int64)
        np.cumsum(flags, out=upto[1:])
        return np.diff(upto[offs])

    hasher = byte_hasher(buf)
    return {
        "n_words": words.counts.astype(np.int64),
        "word_chars": per_text(words.inside & ((buf & 0xC0) != 0x80)),
        "n_symbols": per_text(_IS_SYMBOL[buf]),
        "n_dup_lines": _duplicate_lines(block, words, hasher),
        "n_repeat_words": _repeated_words(words, hasher.of(words.starts, words.ends), n),
    }


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the elements that share their key with another, and whether each is the first such."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    later, any_ = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    later[order[1:][same]] = True
    any_[order[1:][same]] = True
    any_[order[:-1][same]] = True
    return any_, later


def _duplicate_lines(block: Block, words: Words, hasher) -> np.ndarray:
    n, offs = len(block), block.offs
    breaks = np.flatnonzero(block.buf == 10)
    starts = np.concatenate((offs[:-1], breaks + 1))
    doc = np.concatenate((np.arange(n), np.searchsorted(offs, breaks, side="right") - 1))
    order = np.lexsort((starts, doc))
    starts, doc = starts[order], doc[order]
    ends = np.append(starts[1:] - 1, 0)
    last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
    ends[last] = offs[doc[last] + 1]
    with_word = np.searchsorted(words.starts, starts) < np.searchsorted(words.starts, ends)
    starts, ends, doc = starts[with_word], ends[with_word], doc[with_word]
    _, later = _repeats(mix(hasher.of(starts, ends) + doc.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
    return np.bincount(doc[later], minlength=n).astype(np.int64)


def _repeated_words(words: Words, hashes: np.ndarray, n: int) -> np.ndarray:
    at, doc = words.windows(3)
    if not len(at):
        return np.zeros(n, dtype=np.int64)
    key = hashes[at] * np.uint64(3) + mix(hashes[at + 1] + np.uint64(1)) * np.uint64(5) + mix(hashes[at + 2] + np.uint64(2)) * np.uint64(7)
    any_, _ = _repeats(mix(key + doc.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
    covered = np.zeros(len(words) + 1, dtype=bool)
    for j in range(3):
        covered[at[any_] + j] = True
    upto = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(covered[: len(words)], out=upto[1:])
    return np.diff(upto[words.ptr])


BASE_SCHEMA = "doc_id long, lang string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, bits double, n_scored long"
BITS_SCHEMA = "lang string, text_hash long, bits double"


def _score(batches: Iterator[pa.RecordBatch], part) -> Iterator[pa.RecordBatch]:
    """Rows of ``BASE_SCHEMA`` with the bits of the first part and any columns after the fifth, or of ``BITS_SCHEMA`` with the bits of another part."""
    scorer = Scorer(part.value)
    first = part.value.number == 0
    for batch in batches:
        found: dict[str, list[np.ndarray]] = {}
        groups = batch.column(3).to_numpy(zero_copy_only=False)
        for block in blocks(batch.column(4)):
            got = base_counts(block) if first else {}
            bits, count = scorer(block, groups[block.first : block.first + len(block)])
            got |= {"bits": bits, "n_scored": count.astype(np.int64)} if first else {"bits": bits}
            for name, values in got.items():
                found.setdefault(name, []).append(values)
        if found:
            columns = {k: pa.array(np.concatenate(v)) for k, v in found.items()}
            named = {n: batch.column(i) for i, n in enumerate(("doc_id", "lang", "text_hash")) if first or n != "doc_id"} | columns
            if first:
                named |= {n: batch.column(i) for i, n in enumerate(batch.schema.names) if i > 4}
            yield pa.RecordBatch.from_arrays([*named.values()], names=[*named])


def scored(docs: DataFrame, model: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", entries: int = ENTRIES, carry: bool = False, folds: int = FOLDS) -> DataFrame:
    """Base counts and log2 perplexity a symbol of every row; ``model`` was fitted to the same documents and folds.

    With ``carry`` the columns of ``docs`` follow as ``c0``, ``c1`` and so on.
    """
    spark = docs.sparkSession
    grp = F.coalesce(F.col(lang).cast("string"), F.lit(""))
    body = F.col(text).cast("string")
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)] if carry else []
    kinds = "".join(f", c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema)) if carry else ""
    source = docs.select(F.col(key).cast("long").alias("doc_id"), grp.alias("lang"), F.xxhash64(body).alias("text_hash"), F.xxhash64(grp, fold_of(body, folds)).alias("grp"), body.alias("text"), *own)
    rows, more = None, []
    for part in parts(model, entries=entries):
        shared = spark.sparkContext.broadcast(part)
        if part.number == 0:
            rows = checkpointed(source.mapInArrow(lambda it, shared=shared: _score(it, shared), BASE_SCHEMA + kinds))
        else:
            out = source.select("doc_id", "lang", "text_hash", "grp", "text").mapInArrow(lambda it, shared=shared: _score(it, shared), BITS_SCHEMA)
            more.append(checkpointed(out.groupBy("lang", "text_hash").agg(F.max("bits").alias("more"))))
        shared.destroy()
    if more:
        # equal texts got equal bits, so one of them stands for all
        added = reduce(DataFrame.unionByName, more).groupBy("lang", "text_hash").agg(F.sum("more").alias("more"))
        rows = rows.join(added, ["lang", "text_hash"]).withColumn("bits", F.col("bits") + F.col("more"))
    names = BASE_SCHEMA.split(", ")[:8]
    return rows.select(*[n.split()[0] for n in names], F.when(F.col("n_scored") > 0, -F.col("bits") / F.col("n_scored")).alias("log2_ppl"), *[f"c{i}" for i in range(len(own))])


def bands(rows: DataFrame, width: float = BAND, least: tuple[float, float] = LEAST_BAND) -> DataFrame:
    """(lang, ppl_low, ppl_high) over the distinct texts that pass the base rules."""
    texts = rows.where(F.col("log2_ppl").isNotNull() & ~base_failed()).groupBy("lang", "text_hash").agg(F.min("log2_ppl").alias("x"))
    texts = checkpointed(texts.select("lang", "x"))
    middle = texts.groupBy("lang").agg(F.percentile_approx("x", 0.5, 10000).alias("mid"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_TEXTS).drop("n")
    spread = texts.join(F.broadcast(middle), "lang").groupBy("lang", "mid").agg(F.percentile_approx(F.abs(F.col("x") - F.col("mid")), 0.5, 10000).alias("mad"))
    half = lambda i: F.greatest(F.lit(least[i]), width * 1.4826 * F.col("mad"))
    return checkpointed(spread.select("lang", (F.col("mid") - half(0)).alias("ppl_low"), (F.col("mid") + half(1)).alias("ppl_high")))


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _judged(rows: DataFrame, width: float, least: tuple[float, float]) -> DataFrame:
    inside = F.col("log2_ppl").isNull() | F.col("ppl_low").isNull() | F.col("log2_ppl").between(F.col("ppl_low"), F.col("ppl_high"))
    out = rows.join(F.broadcast(bands(rows, width, least)), "lang", "left")
    return out.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & inside})


def assess(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", width: float = BAND, least: tuple[float, float] = LEAST_BAND, entries: int = ENTRIES) -> DataFrame:
    """One row per document: base counts, base_failed, log2_ppl, the band and kept."""
    out = _judged(scored(docs, fit(docs, text, lang), key, text, lang, entries), width, least)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.when(F.col("lang") != "", F.col("lang")).alias("lang"), "text_hash", "log2_ppl", "ppl_low", "ppl_high",
    )


def kept_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", width: float = BAND, least: tuple[float, float] = LEAST_BAND, entries: int = ENTRIES) -> DataFrame:
    """The rows of ``docs`` that ``assess`` keeps, which it carries along, so that nothing is joined to them."""
    out = _judged(scored(docs, fit(docs, text, lang), key, text, lang, entries, carry=True), width, least)
    return out.where("kept").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
