"""Personal data: base patterns, and candidates that boosted trees decide on.

Everything runs as columns of the row (no Python, no exchange): a pattern's matches and
the gaps between them give each match's place, array functions check and score it, and a
row never leaves its task, so neither a hot source nor a long text moves data.

Base kinds (leftmost, non-overlapping, failing matches dropped): email, ip, card (Luhn),
phone. Candidates come from generators of high recall whose spans may overlap each other
and the base: written-out e-mail addresses, national telephone numbers, social security
numbers, IPv6 addresses (shortened ones too), bank account numbers (in fours or as one word, with their check
digits as a feature), secrets after a naming word, and keys of issued forms. Format
and context features of each go through gradient-boosted trees, fitted on the driver from
``training_rows`` (a labelled table of about 1,100 sentences, half of them held back to
set a threshold a kind at ``PRECISION``). A candidate at or over its kind's threshold is
selected unless it overlaps a base span or a better candidate.

The patterns are possessive forms of the plain ones with a guard at their start, which
match the same spans in time linear in the text. Places are running totals in runs of
``RUN`` matches, and spans are compared within groups that touch, so that many matches in
one text cost little more than as many in many texts.

Cases: a null text counts as empty; ties between overlapping candidates go to the
leftmost, then the longest; equal rows get equal rows; a null key is passed through;
columns other than the named ones are ignored; an empty table gives no rows. Places are
code points, end exclusive.
"""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Boosted, fit, threshold
from .session import numbered

PRECISION = 0.98
CONTEXT = 24
#: Elements of a run of running totals.
RUN = 256

LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
IP_PARTS = rf"^{_PART}(?:\.{_PART}){{3}}$"

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("ssn", "ip6", "iban", "secret")
KINDS = (*BASE_KINDS, *ADDED_KINDS)

_GROUP = "[0-9A-Fa-f]{1,4}"
#: Forms in which services issue keys, by their prefixes.
_ISSUED = r"A[KS]IA[0-9A-Z]{16}|gh[opsur]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,250}+|sk[-_][0-9A-Za-z_-]{20,250}+|AIza[0-9A-Za-z_-]{35}|eyJ[0-9A-Za-z_-]{10,2000}+\.eyJ[0-9A-Za-z_-]{10,4000}+\.[0-9A-Za-z_-]{10,2000}+"

#: Generator: kind, pattern, and a cheap test that a text must pass to be searched.
GENERATORS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,}+ ?[(\[{] ?(?i:at) ?[)\]}] ?[A-Za-z0-9-]{2,63}+(?: ?[(\[{] ?(?i:dot) ?[)\]}] ?[A-Za-z0-9-]{2,63}+|\.[A-Za-z0-9-]{2,63}+){1,4}", r"[(\[{] ?(?i:at) ?[)\]}]"),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,}+ (?i:at) [A-Za-z0-9-]{2,63}+(?: (?i:dot) [A-Za-z0-9-]{2,63}+){1,4}", r" (?i:dot) "),
    ("phone", r"(?<![0-9A-Za-z.,+-])\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9A-Za-z])", r"[0-9]{4}"),
    ("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", r"[0-9]-[0-9]{2}-[0-9]"),
    ("ip6", rf"(?<![0-9A-Za-z:])(?:(?:{_GROUP}:){{7}}{_GROUP}|{_GROUP}(?::{_GROUP}){{0,6}}+::(?:{_GROUP}(?::{_GROUP}){{0,6}}+)?|::{_GROUP}(?::{_GROUP}){{1,6}}+)(?![0-9A-Za-z:])", r":[0-9A-Fa-f]{0,4}:"),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}+(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30}+)(?![0-9A-Za-z])", r"[A-Z]{2}[0-9]{2}"),
    ("secret", r"(?<![0-9A-Za-z_+/-])[0-9A-Za-z_+/-]{16,}+(?![0-9A-Za-z_+/-])", r"(?i:token|secret|passw|key|auth)"),
    ("secret", rf"(?<![0-9A-Za-z_+/-])(?:{_ISSUED})(?![0-9A-Za-z_+/-])", r"A[KS]IA|gh[opsur]_|xox|sk[-_]|eyJ|AIza"),
)

_POSITIVE = r"(?i)(?:phone|tel|call|mobile|fax|cell|contact|reach|mail|write|ssn|social|security|address|host|ip|iban|account|bank|token|secret|passw\w*|key|auth\w*)\W{0,4}(?:\w{1,4}\W{0,3})?$"
_NEGATIVE = r"(?i)(?:order|invoice|version|isbn|page|figure|ref\w*|sku|total|amount|build|issue|part|serial|model|code|lot|batch|item|commit|hash|checksum|sha\d*|md5)\W{0,4}(?:\w{1,4}\W{0,3})?$"

_MATCH = "struct<s:int,e:int,v:string,before:string,after:string>"


def _matches(text: Column, pattern: str, guard: Column) -> Column:
    """All matches of a pattern; null where the guard fails."""
    return F.when(guard, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def _paired(text: Column, matches: Column, pattern: str) -> Column:
    """Matches ``m`` with the gaps ``g`` around them; null without a match."""
    return F.when(F.size(matches) > 0, F.struct(matches.alias("m"), F.split(text, pattern, -1).alias("g")))


def _steps(pair: Column) -> Column:
    """Characters from each match's gap on to its end."""
    return F.zip_with(pair["m"], F.slice(pair["g"], F.lit(1), F.size(pair["m"])), lambda m, g: F.length(g) + F.length(m))


def _runs(values: Column, value, join) -> Column:
    """Running totals of an array, in runs of ``RUN`` that start anew: struct (all: of the run, upto: before each element).

    An array that grows is copied with every element; runs of fixed length keep that linear.
    """
    start = F.struct(F.lit(0).alias("all"), F.expr("cast(array() as array<int>)").alias("upto"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct(join(acc["all"], value(x)).alias("all"), F.concat(acc["upto"], F.array(acc["all"])).alias("upto"))

    numbers = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / RUN).cast("int"))
    return F.when(F.size(values) > 0, F.transform(numbers, lambda r: F.aggregate(F.slice(values, r * RUN + 1, F.lit(RUN)), start, step)))


def _joined(runs: Column, join) -> Column:
    """The total before each element, from ``_runs``; runs of runs keep even this short."""
    start = F.struct(F.lit(0).alias("all"), F.expr("cast(array() as array<int>)").alias("upto"))
    of_runs = F.aggregate(runs, start, lambda acc, r: F.struct(join(acc["all"], r["all"]).alias("all"), F.concat(acc["upto"], F.array(acc["all"])).alias("upto")), lambda acc: acc["upto"])
    return F.flatten(F.zip_with(runs, of_runs, lambda r, before: F.transform(r["upto"], lambda x: join(before, x))))


def _placed(pair: Column, before: Column) -> Column:
    """The matches with their places, from matches ``m`` and the gaps ``g`` around them, and the place before each gap."""
    n = F.size(pair["m"])
    zipped = F.arrays_zip(pair["m"].alias("v"), F.slice(pair["g"], F.lit(1), n).alias("gap"), F.slice(pair["g"], F.lit(2), n).alias("next"), before.alias("p"))

    def item(z: Column) -> Column:
        start = z["p"] + F.length(z["gap"])
        return F.struct(start.alias("s"), (start + F.length(z["v"])).alias("e"), z["v"].alias("v"), F.right(z["gap"], F.lit(CONTEXT)).alias("before"), F.left(F.coalesce(z["next"], F.lit("")), F.lit(CONTEXT)).alias("after"))

    return F.when(pair.isNotNull(), F.transform(zipped, item)).otherwise(F.expr(f"cast(array() as array<{_MATCH}>)"))


def _with_places(rows: DataFrame, keep: list[Column], patterns: dict[str, str], text: str) -> DataFrame:
    """Columns ``__<name>`` of matches to arrays of placed matches. Each step is a projection of its own and uses what it needs twice, so that none is put into a lambda and done anew for each element."""
    names = [f"__{k}" for k in patterns]
    plus = lambda a, b: a + b
    rows = rows.select(*keep, *[_paired(F.col(text), F.col(n), p).alias(n) for n, p in zip(names, patterns.values(), strict=True)])
    rows = rows.select(*keep, *names, *[F.when(F.col(n).isNotNull(), _steps(F.col(n))).alias(f"{n}_a") for n in names])
    rows = rows.select(*keep, *names, *[_runs(F.col(f"{n}_a"), lambda x: x, plus).alias(f"{n}_a") for n in names])
    return rows.select(*keep, *[_placed(F.col(n), _joined(F.col(f"{n}_a"), plus)).alias(n) for n in names])


def _clustered(rows: DataFrame, keep: list[str], spans: str) -> DataFrame:
    """``__clusters``: the spans (sorted by start) in groups that touch no other group; null without a span."""
    rows = rows.select(*keep, spans, _runs(F.col(spans), lambda x: x["e"], F.greatest).alias("__a"))
    rows = rows.select(*keep, spans, F.when(F.size(spans) > 0, _joined(F.col("__a"), F.greatest)).alias("__a"))
    heads = F.filter(F.transform(F.arrays_zip(F.col(spans).alias("x"), F.col("__a").alias("p")), lambda z, i: F.when((i == 0) | (z["x"]["s"] >= z["p"]), i)), lambda i: i.isNotNull())
    rows = rows.select(*keep, spans, F.when(F.size(spans) > 0, heads).alias("__a"))
    after = F.concat(F.slice("__a", F.lit(2), F.size("__a")), F.array(F.size(spans)))
    return rows.select(*keep, F.when(F.size(spans) > 0, F.zip_with("__a", after, lambda a, b: F.slice(F.col(spans), a + 1, b - a))).alias("__clusters"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        d = F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return acc + d

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _mod97(value: Column) -> Column:
    """Remainder of an account number by 97, its first four characters moved to the end and letters read as 10 to 35; 1 for a valid one."""
    plain = F.regexp_replace(value, " ", "")
    moved = F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), "")
    number = lambda c: F.when(F.ascii(c) < 58, F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(moved, lambda c: c != ""), F.lit(0), lambda acc, c: (acc * F.when(F.ascii(c) < 58, 10).otherwise(100) + number(c)) % 97)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(IP_PARTS)
    if kind == "card":
        return F.when(F.length(_digits(value)).between(13, 19), _luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


# --- candidates ---------------------------------------------------------------------------------


def _count(value: Column, drop: str) -> Column:
    return F.length(F.regexp_replace(value, drop, "")).cast("double")


def _features(generator: int, c: Column) -> dict[str, Column]:
    v = c["v"]
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    return {
        "generator": F.lit(float(generator)),
        "length": F.length(v).cast("double"),
        "digits": _count(v, "[^0-9]"),
        "letters": _count(v, "[^A-Za-z]"),
        "separators": _count(v, "[^ ().:-]"),
        "brackets": flag(v.rlike(r"[(\[{]")),
        "hex": flag(v.rlike("^[0-9a-f]+$")),
        "mixed": flag(v.rlike("[0-9]") & v.rlike("[A-Za-z]")),
        "assigned": flag(c["before"].rlike(r"[:=]\s?[\"']?$")),
        "quoted": flag(c["before"].rlike("[\"']$") & c["after"].rlike("^[\"']")),
        "positive": flag(c["before"].rlike(_POSITIVE)),
        "negative": flag(c["before"].rlike(_NEGATIVE)),
        "leading_zero": flag(v.rlike(r"^\(?[01]")),
        "checked": flag(_mod97(v) == 1) if GENERATORS[generator][0] == "iban" else F.lit(0.0),
        "issued": F.lit(1.0 if _ISSUED in GENERATORS[generator][1] else 0.0),
        "shortened": flag(v.contains("::")),
    }


_FEATURES = ["generator", "length", "digits", "letters", "separators", "brackets", "hex", "mixed", "assigned", "quoted", "positive", "negative", "leading_zero", "checked", "issued", "shortened"]


def training_rows() -> list[tuple[str, str, int]]:
    """(sentence with one candidate, kind, label): what the trees are fitted on."""
    rows = []
    names = ["anna.lind", "jo_berg", "m.costa", "sales", "kim42", "r-patel"]
    hosts = ["example", "mailhost", "uni-nord", "firma"]
    for (i, n), (j, h) in product(enumerate(names), enumerate(hosts)):
        forms = [f"{n} (at) {h} (dot) com", f"{n}[at]{h}[dot]org", f"{n} [at] {h}.net", f"{n} at {h} dot com", f"{n} at {h} dot co dot uk"]
        rows.append((f"You can write to {forms[(i + j) % 5]} for more.", "email", 1))
        rows.append((f"contact: {forms[(i + j + 2) % 5]}", "email", 1))
    for a, b in product(["look", "meet", "stop", "aim", "stay"], ["this", "every", "some", "another"]):
        rows.append((f"They {a} at {b} dot on the map.", "email", 0))
        rows.append((f"{a} (at) {b} (dot) pattern", "email", 0))
    for k in range(40):
        a, b, c = 201 + 17 * k, 220 + 13 * k, 1000 + 211 * k
        forms = [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}"]
        lead = ["call me at ", "Tel: ", "phone ", "mobile: ", "reach us on ", "and so "]
        rows.append((f"Please {lead[k % 6]}{forms[k % 3]} today", "phone", 1))
        rows.append((f"Fax {forms[(k + 1) % 4]}.", "phone", 1))
        bad = ["order ", "Invoice no. ", "item ", "serial: ", "total ", "the "]
        rows.append((f"see {bad[k % 6]}{a}{b}{c} in the list", "phone", 0))
        rows.append((f"{bad[(k + 1) % 5]}{forms[k % 4]} was sent", "phone", 0))
        s = f"{100 + 13 * k:03d}-{10 + 2 * k % 89:02d}-{1000 + 97 * k}"
        rows.append((f"his {['SSN ', 'social security number ', 'ssn: '][k % 3]}{s} is", "ssn", 1))
        rows.append((f"the {['part ', 'order ', 'ISBN ', 'model ', 'code ', 'on '][k % 6]}{s} is", "ssn", 0))
    rng = np.random.default_rng(4)
    for k in range(40):
        h = "".join(rng.choice(list("0123456789abcdef"), 40))
        m = "".join(rng.choice(list("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789"), 32))
        word = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 20))
        name = ["token", "api_key", "secret", "password", "auth_token"][k % 5]
        rows.append((f'{name} = "{h}" in the file', "secret", 1))
        rows.append((f"the {name}: {m}", "secret", 1))
        rows.append((f"commit {h} fixes the key", "secret", 0))
        rows.append((f"a key point is {word} for all", "secret", 0))
        rows.append((f"sha256 {h}{h[:24]} of the auth file", "secret", 0))
        six = ":".join(f"{int(x):x}" for x in rng.integers(0, 65536, 8))
        rows.append((f"{['host ', 'from ', 'address '][k % 3]}{six} connected", "ip6", 1))
        low = ":".join(f"{(k + i) % 10}" for i in range(8))
        rows.append((f"{['model ', 'ratio ', 'code '][k % 3]}{low} shown", "ip6", 0))
        d = "".join(rng.choice(list("0123456789"), 18))
        rows.append((f"{['IBAN ', 'account ', 'bank account '][k % 3]}DE{d[:2]} {d[2:6]} {d[6:10]} {d[10:14]} {d[14:18]}", "iban", 1))
        rows.append((f"{['part ', 'serial ', 'lot '][k % 3]}XK{d[:2]} {d[2:6]} {d[6:10]} {d[10:14]}", "iban", 0))
    return rows + _more_rows(np.random.default_rng(6))


def account_number(country: str, body: str) -> str:
    """An account number with its check digits."""
    number = int("".join(str(int(c, 36)) for c in body + country + "00"))
    return f"{country}{98 - number % 97:02d}{body}"


def _more_rows(rng: np.random.Generator) -> list[tuple[str, str, int]]:
    """Account numbers by their check digits, shortened IPv6 addresses, and keys that their prefix gives away."""
    pick = lambda letters, n: "".join(rng.choice(list(letters), n))
    digits, upper, every = "0123456789", "0123456789ABCDEFGHJKLMNPQRSTUVWXYZ", "0123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
    spaced = lambda x: " ".join(x[i : i + 4] for i in range(0, len(x), 4))
    leads = ["pay to ", "IBAN ", "send it to ", "account ", "and ", "transfer: "]
    rows = []
    for k in range(40):
        body = [pick(digits, 18), pick("ABCDEFGH", 4) + pick(digits, 14), pick(digits, 10) + pick(upper, 11) + pick(digits, 2), pick(digits, 14)][k % 4]
        good = account_number(["DE", "GB", "FR", "NO"][k % 4], body)
        # check digits that are wrong by one
        bad = good[:2] + f"{(int(good[2:4]) + 1) % 100:02d}" + good[4:]
        rows.append((f"Please {leads[k % 6]}{(good, spaced(good))[k // 2 % 2]} soon", "iban", 1))
        rows.append((f"{leads[(k + 2) % 6]}{(spaced(good), good)[k // 2 % 2]}.", "iban", 1))
        rows.append((f"{['the ', 'model ', 'and ', 'lot '][k % 4]}{(bad, spaced(bad))[k // 2 % 2]} is in stock", "iban", 0))
        rows.append((f"{['part ', 'serial ', 'see '][k % 3]}{pick('ABXYZ', 2)}{pick(digits, 2)}{pick(upper, 12)} again", "iban", 0))
        groups = [f"{int(x):x}" for x in rng.integers(16, 65536, 6)]
        n = 1 + k % 4
        rows.append((f"{['from ', 'host ', 'at ', 'and '][k % 4]}{':'.join(groups[:n])}::{':'.join(groups[n : n + 1 + k % 2])} came", "ip6", 1))
        rows.append((f"{['address ', 'is ', 'to '][k % 3]}2001:db8{':0' * (k % 3)}::{groups[0]}", "ip6", 1))
        rows.append((f"the {['dead::beef', 'face::add', 'a::b', 'cafe::bad', 'ab::cd', '1::2'][k % 6]} {['name', 'class', 'scope', 'ratio'][k % 4]}", "ip6", 0))
        rows.append((f"{['type ', 'call ', 'use '][k % 3]}{['bed::fade', 'c::d', 'decade::fee', 'b::a', 'add::ace'][k % 5]} here", "ip6", 0))
        issued = [f"AKIA{pick(upper, 16)}", f"ghp_{pick(every, 36)}", f"xoxb-{pick(digits, 12)}-{pick(every, 24)}", f"sk-{pick(every, 40)}", f"AIza{pick(every, 35)}", f"eyJ{pick(every, 30)}.eyJ{pick(every, 60)}.{pick(every, 43)}"][k % 6]
        rows.append((f"{['it is ', 'with ', 'export ', 'run '][k % 4]}{issued} now", "secret", 1))
        rows.append((f"{['log: ', '', 'here ', 'use '][k % 4]}{issued}", "secret", 1))
    # every form among the fitted and the held back
    return [rows[i] for i in rng.permutation(len(rows))]


def _candidates(text: Column) -> list[Column]:
    return [_matches(text, pattern, text.rlike(test)) for _, pattern, test in GENERATORS]


_FITTED: dict[float, tuple[Boosted, dict[str, float]]] = {}


def fitted(spark: SparkSession, precision: float = PRECISION) -> tuple[Boosted, dict[str, float]]:
    """The trees and a threshold a kind; the table's features come from the same columns as a corpus's."""
    if precision not in _FITTED:
        quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
        rows = training_rows()
        values = ", ".join(f"({i}, {quoted(s)}, {quoted(kind)}, {label})" for i, (s, kind, label) in enumerate(rows))
        table = spark.sql(f"SELECT * FROM VALUES {values} AS t(i, text, kind, label)").coalesce(1)
        own = [F.col(c) for c in ("i", "label", "kind", "text")]
        matched = table.select(*own, *[m.alias(f"__g{g}") for g, m in enumerate(_candidates(F.col("text")))])
        placed = _with_places(matched, own, {f"g{g}": p for g, (_, p, _) in enumerate(GENERATORS)}, "text")
        rows_of = lambda g: F.transform(f"__g{g}", lambda c: F.array(*_features(g, c).values()))
        every = F.flatten(F.array(*[rows_of(g) for g in range(len(GENERATORS))]))
        got = placed.select("i", "label", "kind", F.explode(every).alias("f")).collect()
        kinds = np.array([GENERATORS[int(r.f[0])][0] for r in got])
        x = np.array([r.f for r in got])
        y = np.array([r.label if kind == r.kind else 0 for kind, r in zip(kinds, got, strict=True)], dtype=float)
        held = np.array([(r.i // 2) % 2 == 1 for r in got])
        model = fit(x[~held], y[~held], _FEATURES)
        score = model.raw(x)
        limits = {k: max(0.0, threshold(score[held & (kinds == k)], y[held & (kinds == k)], precision)) for k in sorted({g[0] for g in GENERATORS})}
        _FITTED[precision] = (model, limits)
    return _FITTED[precision]


def _overlap(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


_SPAN = "array<struct<k:int,s:int,e:int,score:double>>"
_PLACE = "array<struct<s:int,e:int,k:int,score:double>>"


def annotated(docs: DataFrame, text: str = "text", precision: float = PRECISION) -> DataFrame:
    """``docs`` with ``__base`` and ``__all``: arrays of (kind number, s, e, score), sorted by kind then start."""
    model, limits = fitted(docs.sparkSession, precision)
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    own = [F.col(f"`{c}`") for c in docs.columns]
    digit = F.col("__t").rlike("[0-9]")
    base = {
        "email": (EMAIL, F.instr("__t", "@") > 0), "ip": (IP, digit & F.col("__t").rlike(r"[0-9]\.[0-9]")),
        "card": (CARD, digit), "phone": (PHONE, digit & (F.instr("__t", "+") > 0)),
    }
    step = docs.select(*own, body.alias("__t"))
    step = step.select("*", *[_matches(F.col("__t"), p, g).alias(f"__{k}") for k, (p, g) in base.items()], *[m.alias(f"__g{g}") for g, m in enumerate(_candidates(F.col("__t")))])
    patterns = {**{k: p for k, (p, _) in base.items()}, **{f"g{g}": p for g, (_, p, _) in enumerate(GENERATORS)}}
    step = _with_places(step, own, patterns, "__t")

    def plain(k: str) -> Column:
        number = KINDS.index(k)
        return F.transform(
            F.filter(f"__{k}", lambda c: _valid(k, c["v"])), lambda c: F.struct(F.lit(number).alias("k"), c["s"].alias("s"), c["e"].alias("e"), F.lit(None).cast("double").alias("score"))
        ).cast(_SPAN)

    def chosen(g: int, kind: str) -> Column:
        number = KINDS.index(kind)
        scored = F.transform(f"__g{g}", lambda c: F.struct(F.lit(number).alias("k"), c["s"].alias("s"), c["e"].alias("e"), model.column(_features(g, c)).alias("score")))
        return F.filter(scored, lambda c: c["score"] >= limits[kind]).cast(_SPAN)

    step = step.select(
        *own,
        F.concat(*[plain(k) for k in BASE_KINDS]).alias("__base"),
        F.concat(*[F.when(F.size(f"__g{g}") > 0, chosen(g, kind)).otherwise(F.expr(f"cast(array() as {_SPAN})")) for g, (kind, _, _) in enumerate(GENERATORS)]).alias("__new"),
    )
    by_place = lambda spans: F.transform(spans, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["k"].alias("k"), c["score"].alias("score"))).cast(_PLACE)
    # where nothing was added, nothing has to be chosen
    step = step.select(*own, "__base", F.when(F.size("__new") > 0, F.array_sort(F.concat(by_place("__base"), by_place("__new")))).alias("__spans"))
    step = _clustered(step, [*own, F.col("__base")], "__spans")
    free = lambda c: F.filter(c, lambda x: x["score"].isNotNull() & ~F.exists(c, lambda y: y["score"].isNull() & _overlap(x, y)))
    step = step.select(*own, "__base", F.transform("__clusters", free).alias("__clusters"))
    better = lambda c, o: _overlap(c, o) & (
        (o["score"] > c["score"]) | ((o["score"] == c["score"]) & ((o["s"] < c["s"]) | ((o["s"] == c["s"]) & ((o["e"] > c["e"]) | ((o["e"] == c["e"]) & (o["k"] < c["k"]))))))
    )
    best = F.flatten(F.transform("__clusters", lambda f: F.array_distinct(F.filter(f, lambda c: ~F.exists(f, lambda o: better(c, o))))))
    by_kind = F.transform(best, lambda c: F.struct(c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e"), c["score"].alias("score"))).cast(_SPAN)
    return step.select(*own, "__base", F.array_sort(F.concat("__base", F.coalesce(by_kind, F.expr(f"cast(array() as {_SPAN})")))).alias("__all"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.get(names, c["k"]), c["s"].cast("string"), c["e"].cast("string"))), ",")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", precision: float = PRECISION) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row."""
    rows = annotated(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "text", precision)
    number = lambda k: F.size(F.filter("__base", lambda c: c["k"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return rows.select(
        "doc_id", *[number(k) for k in BASE_KINDS], F.sha2(_listed(F.col("__base")), 256).alias("base_sha256"), _listed(F.col("__all")).alias("spans"),
        (F.size("__all") - F.size("__base")).cast("long").alias("n_added"),
    )


def redact(docs: DataFrame, text: str = "text", precision: float = PRECISION) -> DataFrame:
    """``docs`` with every selected span of ``text`` replaced by its kind in brackets; a null text stays null.

    Of overlapping spans the first is named, and what the others cover goes with it.
    """
    plain, (text,) = numbered(docs, text)
    own = [F.col(c) for c in plain.columns]
    rows = annotated(plain, text, precision)
    place = F.transform("__all", lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["k"].alias("k"), c["score"].alias("score"))).cast(_PLACE)
    rows = _clustered(rows.select(*own, F.array_sort(place).alias("__spans")), own, "__spans")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    whole = F.transform("__clusters", lambda c: F.struct(c[0]["s"].alias("s"), F.array_max(F.transform(c, lambda x: x["e"])).alias("e"), F.get(names, c[0]["k"]).alias("name")))
    rows = rows.select(*own, whole.alias("__r"))
    rows = rows.select(*own, F.zip_with("__r", F.concat(F.array(F.lit(0)), F.transform("__r", lambda r: r["e"])), lambda r, p: F.struct(r["s"].alias("s"), r["e"].alias("e"), r["name"].alias("name"), p.alias("p"))).alias("__r"))
    body = F.col(text).cast("string")
    # the text is cut at every RUN-th region first, so that no region is looked for from the start of a long text
    numbers = F.sequence(F.lit(0), F.floor((F.size("__r") - 2) / RUN).cast("int"))
    rows = rows.select(*own, "__r", F.when(F.size("__r") > 1, F.transform(numbers, lambda i: F.filter(F.slice("__r", i * RUN + 1, F.lit(RUN)), lambda r: r["s"].isNotNull()))).alias("__c"))
    part = lambda c: F.struct(c.alias("r"), F.substring(body, c[0]["p"] + 1, F.element_at(c, -1)["e"] - c[0]["p"]).alias("t"))
    rows = rows.select(*own, F.element_at("__r", -1)["p"].alias("__end"), F.transform("__c", part).alias("__c"))
    piece = lambda c: lambda r: F.concat(F.substring(c["t"], r["p"] - c["r"][0]["p"] + 1, r["s"] - r["p"]), r["name"])
    done = F.concat(F.array_join(F.transform("__c", lambda c: F.array_join(F.transform(c["r"], piece(c)), "")), ""), F.substring(body, F.col("__end") + 1, F.length(body)))
    out = F.when(F.col("__c").isNotNull(), done).otherwise(body)
    return rows.select(*[out.alias(c) if c == text else F.col(c) for c in plain.columns]).toDF(*docs.columns)
