"""URL filter: a rule list, and logistic regression for what no rule decides.

Features are hashed character n-grams (3 to 5) of the host, framed by ``^`` and ``$``, and
of the path, in separate halves of ``BUCKETS`` weights. The model is trained on the driver
from ``labelled()``, a table of some thousand URLs made of subjects stated here; the weights (256 KB) go to the
executors. Scoring works on arrays of byte windows, a batch at a time.

Cases: a null URL or one without ``://`` has an empty host and path, no rule, and the
model's verdict on no features (its intercept: allow); a URL without a path has an empty
path, which no rule fits; equal rows get equal rows; a null key is passed through; columns
other than the named ones are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textblocks import RangeHasher, _BYTE_CODES, blocks

BUCKETS = 1 << 15
GRAMS = (3, 4, 5)

#: (host, path, verdict); a rule fits its host and all subdomains where the path starts with its own.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: Subjects of hosts that are blocked and of hosts that are not, by what they are about.
BAD_WORDS = (
    "poker", "jackpot", "slots", "roulette", "blackjack", "bingo", "sportsbook", "wager", "escort", "webcam", "erotic", "porn", "nude", "pharmacy-discount", "weight-loss", "male-enhancement",
    "payday", "quick-cash", "loan-approval", "get-rich", "crypto-doubler", "giveaway", "prize-winner", "counterfeit", "fake-id", "keygen", "cracked", "nulled", "pirated", "phishing", "malware",
    "popunder", "adserver", "tracker", "clickbait", "spamlist",
)
GOOD_WORDS = (
    "library", "university", "college", "museum", "science", "history", "weather", "recipes", "gardening", "council", "parliament", "hospital", "clinic", "nursing", "railway", "airport", "harbour",
    "bakery", "bookshop", "furniture", "carpenter", "plumbing", "insurance", "notary", "orchestra", "theatre", "cinema", "gallery", "football", "swimming", "cycling", "hiking", "archive", "dictionary",
    "encyclopedia", "mathematics", "astronomy", "geology", "newspaper", "magazine", "radio", "kindergarten", "parish", "charity", "farmers", "forestry",
)
_TAILS = ("", "-online", "-world", "24", "hub")
_TOPS = ("com", "org", "info", "co.uk", "de")
_PATHS = ("", "/", "/index.html", "/about", "/2021/04/17", "/p/123")
#: Words of which either kind of host may be made, so that they tell nothing by themselves.
_FILLERS = ("best", "my", "the", "city", "north", "free", "top", "blue")


def labelled(bad: tuple[str, ...] = BAD_WORDS, good: tuple[str, ...] = GOOD_WORDS) -> tuple[tuple[str, int], ...]:
    """The labelled table: (url, 1 to block). Each subject stands alone and behind a filler, under every tail; ends and paths are dealt alike to both kinds."""
    rows = []
    for label, words in ((1, bad), (0, good)):
        for i, (word, tail) in enumerate(product(words, _TAILS)):
            hosts = (f"{word}{tail}", f"{_FILLERS[i % len(_FILLERS)]}-{word}{tail}", f"{_FILLERS[(3 * i + 1) % len(_FILLERS)]}{word}")
            rows += [(f"https://{'www.' if (i + j) % 2 else ''}{host}.{_TOPS[(i + j) % len(_TOPS)]}{_PATHS[(i + 2 * j) % len(_PATHS)]}", label) for j, host in enumerate(hosts)]
    return tuple(rows)


@dataclass
class LinearModel:
    weights: np.ndarray
    intercept: float


def buckets(column: pa.Array, half: int, frame: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram of a string column; each row's distinct ones once."""
    rows, found = [], []
    for block in blocks(column):
        buf, offs = block.buf, block.offs
        if frame:
            n = np.diff(offs)
            new = np.empty(len(buf) + 2 * len(n), dtype=np.uint8)
            at = offs[:-1] + 2 * np.arange(len(n))
            inner = np.ones(len(new), dtype=bool)
            inner[at], inner[at + n + 1] = False, False
            new[inner] = buf
            new[at], new[at + n + 1] = ord("^"), ord("$")
            buf, offs = new, np.append(at, len(new))
            empty = np.flatnonzero(n == 0)
        else:
            empty = np.zeros(0, np.int64)
        hasher = RangeHasher(_BYTE_CODES[buf])
        doc = np.repeat(np.arange(len(block)), np.diff(offs))
        for k in GRAMS:
            at = np.arange(max(0, len(buf) - k + 1))
            own = doc[: len(at)]
            ok = (at + k <= offs[own + 1]) & ~np.isin(own, empty)
            rows.append(own[ok] + block.first)
            found.append((hasher.of(at[ok], at[ok] + k) >> np.uint64(32)).astype(np.int64) % (BUCKETS // 2) + half * (BUCKETS // 2))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.unique(np.concatenate(rows) * BUCKETS + np.concatenate(found))
    return code // BUCKETS, code % BUCKETS


def _both(host: pa.Array, path: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    a, b = buckets(host, 0, True), buckets(path, 1, False)
    return np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))


def scores(model: LinearModel, host: pa.Array, path: pa.Array) -> np.ndarray:
    """Probability that a URL is one to block."""
    row, bucket = _both(host, path)
    n = np.bincount(row, minlength=len(host))
    z = np.bincount(row, weights=model.weights[bucket], minlength=len(host)) / np.sqrt(np.maximum(n, 1))
    return 1 / (1 + np.exp(-(z + model.intercept)))


def train(table: tuple[tuple[str, int], ...] | None = None, rounds: int = 300, rate: float = 4.0, ridge: float = 1e-4) -> LinearModel:
    """Batch gradient descent; deterministic."""
    table = table or labelled()
    parts = [split_url(u) for u, _ in table]
    y = np.array([label for _, label in table], dtype=float)
    row, bucket = _both(pa.array([h for h, _ in parts]), pa.array([p for _, p in parts]))
    scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(y)), 1))
    weights, intercept = np.zeros(BUCKETS), -0.5
    for _ in range(rounds):
        z = np.bincount(row, weights=weights[bucket], minlength=len(y)) * scale + intercept
        error = y - 1 / (1 + np.exp(-z))
        weights += rate * (np.bincount(bucket, weights=(error * scale)[row], minlength=BUCKETS) / len(y) - ridge * weights)
    return LinearModel(weights, intercept)


def split_url(url: str) -> tuple[str, str]:
    """Host and path by the same definition as the columns."""
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    tail = rest[end:]
    cut = min((i for i in (tail.find(c) for c in "?#") if i >= 0), default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), tail[:cut]


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        p = scores(model.value, batch.column(1), batch.column(2))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, "score"])


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", model: LinearModel | None = None, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train())
    host, path = host_and_path(F.col(url).cast("string"))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.mapInArrow(lambda it: _scored(it, shared), "page_id long, host string, path string, score double")
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
