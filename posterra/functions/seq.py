"""Nucleotide sequences as strings; letters other than A, C, G, T (and U) are excluded, never guessed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def complement(s: Column) -> Column:
    return F.translate(s, "ACGTUacgtu", "TGCAAtgcaa")


def reverse_complement(s: Column) -> Column:
    return F.reverse(complement(s))


def gc_count(s: Column) -> Column:
    return F.length(F.regexp_replace(s, "[^gcGC]", ""))


def gc_count_range(s: Column, start: Column, end: Column) -> Column:
    """Inclusive 0-based range."""
    return gc_count(F.substring(s, start + 1, end - start + 1))


def nucleotide_code(c: Column) -> Column:
    """a, u = 0, c = 1, g = 2, t = 3; other letters null."""
    return F.when(F.lower(c).isin("a", "u"), 0).when(F.lower(c) == "c", 1).when(F.lower(c) == "g", 2).when(F.lower(c) == "t", 3)


def kmer_number(s: Column) -> Column:
    """Base-4 number of a k-mer; null if a letter is unknown."""
    letters = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(s, i, F.lit(1)))
    return F.aggregate(letters, F.lit(0).cast("long"), lambda acc, c: acc * 4 + nucleotide_code(c))


def kmer_string(number: Column, k: int) -> Column:
    digit = lambda i: F.element_at(F.array(*map(F.lit, "acgt")), (F.shiftright(number, 2 * (k - 1 - i)).bitwiseAND(F.lit(3)) + 1).cast("int"))
    return F.concat(*[digit(i) for i in range(k)])


def masked_kmer_number(s: Column, mask: Column) -> Column:
    """Base-4 number of the letters whose place is true in a boolean array."""
    places = F.filter(F.sequence(F.lit(0), F.length(s) - 1), lambda i: F.get(mask, i))
    return F.aggregate(places, F.lit(0).cast("long"), lambda acc, i: acc * 4 + nucleotide_code(F.substring(s, i + 1, F.lit(1))))


def kmers(s: Column, k: int) -> Column:
    """Array of all k-mers in order."""
    return F.when(F.length(s) >= k, F.transform(F.sequence(F.lit(1), F.length(s) - (k - 1)), lambda i: F.substring(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def padded_substring(s: Column, start: Column, length: Column, pad: str = "N") -> Column:
    """0-based substring; places off either end are padded."""
    left = F.least(F.greatest(-start, F.lit(0)), length)
    begin = F.greatest(start, F.lit(0))
    middle = F.substring(s, begin + 1, F.greatest(F.least(start + length, F.length(s)) - begin, F.lit(0)))
    return F.rpad(F.concat(F.repeat(F.lit(pad), left), middle), length, F.lit(pad))


def spliced(s: Column, exons: Column, left: int = 0, right: int = 0) -> Column:
    """Exon sequences (0-based closed, ascending) joined; the ends may reach beyond the outer exons."""
    body = F.array_join(F.transform(exons, lambda e: padded_substring(s, e["start"], e["end"] - e["start"] + 1)), "")
    head = padded_substring(s, F.element_at(exons, 1)["start"] - left, F.lit(left)) if left else F.lit("")
    tail = padded_substring(s, F.element_at(exons, -1)["end"] + 1, F.lit(right)) if right else F.lit("")
    return F.concat(head, body, tail)


def natural_number(name: Column) -> Column:
    """First integer in a name, 0 without one; ``(natural_number, name)`` is the natural order of sequence names."""
    return F.coalesce(F.regexp_extract(name, r"(\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def attribute_map(s: Column) -> Column:
    """``key "value"; key value;`` to a map; the last of equal keys wins."""
    pairs = F.regexp_extract_all(s, F.lit(r"""([^\s;]+)\s+("[^"]*"|'[^']*'|[^;]*)"""), F.lit(0))
    key = lambda p: F.regexp_extract(p, r"^([^\s;]+)", 1)
    value = lambda p: F.trim(F.regexp_replace(F.regexp_extract(p, r"""^[^\s;]+\s+(.*)$""", 1), r"""^["']|["']\s*$""", ""))
    entries = F.transform(pairs, lambda p: F.struct(key(p).alias("key"), value(p).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


_PAIRS = r"""([^\s;]+)\s+("[^"]*"|'[^']*'|[^;]*)"""


def attribute_lists(s: Column) -> tuple[Column, Column]:
    """Keys and values of ``attribute_map``, from the last to the first, for ``attribute_in``; values have their quotes still."""
    return tuple(F.reverse(F.regexp_extract_all(s, F.lit(_PAIRS), F.lit(i))) for i in (1, 2))


def attribute_in(keys: Column, values: Column, name: str) -> Column:
    """What ``attribute_map`` has under a name, without a map of all; null if there is none."""
    value = F.get(values, F.nullif(F.array_position(keys, F.lit(name)), F.lit(0)).cast("int") - 1)
    # of a value over several lines the map has nothing
    plain = F.when(value.rlike(r"[\n\r\u0085\u2028\u2029]"), F.regexp_extract(value, r"^(.*)$", 1)).otherwise(value)
    return F.trim(F.regexp_replace(plain, r"""^["']|["']\s*$""", ""))


def locus(seqname: Column, start: Column, end: Column, strand: Column) -> Column:
    return F.format_string("%s:%d-%d(%s)", seqname, start, end, strand)
