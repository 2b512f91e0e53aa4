"""DuckDB statements for the catalogue, formulated apart from it: ranks by row_number, depth by joins, pairs by self-joins."""

from __future__ import annotations

SQL: dict[str, str] = {}

NUMBER = r"coalesce(try_cast(regexp_extract({0}, '(\d+)', 1) AS BIGINT), 0)"

CUBE = rf"""
tr AS (
  SELECT transcript_id, gene_id, p_type, CAST(row_number() OVER (ORDER BY {NUMBER.format("gene_id")}, gene_id, transcript_id) - 1 AS INTEGER) AS tid,
         CAST(dense_rank() OVER (ORDER BY gene_id) - 1 AS INTEGER) AS tgroup
  FROM (SELECT DISTINCT p_brand || '|' || p_type AS transcript_id, p_brand AS gene_id, p_type FROM part)
), sm AS (
  SELECT f, s, CAST(row_number() OVER (ORDER BY f, s) - 1 AS INTEGER) AS sample, CAST(dense_rank() OVER (ORDER BY f) - 1 AS INTEGER) AS condition
  FROM (SELECT DISTINCT l_returnflag AS f, l_linestatus AS s FROM lineitem)
), cell AS (
  SELECT CAST((year(l_shipdate) - 1995) * 4 + quarter(l_shipdate) - 1 AS INTEGER) AS draw, l_returnflag AS f, l_linestatus AS s, p_brand || '|' || p_type AS transcript_id,
         sum(CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)) AS cents
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL
), cube AS (
  SELECT d.draw, sm.sample, sm.condition, tr.tid, tr.tgroup, tr.gene_id, 1 + coalesce(cell.cents, 0) AS cents
  FROM (SELECT DISTINCT draw FROM cell) d CROSS JOIN sm CROSS JOIN tr
  LEFT JOIN cell ON cell.draw = d.draw AND cell.f = sm.f AND cell.s = sm.s AND cell.transcript_id = tr.transcript_id
), quant AS (
  SELECT draw, sample, condition, tid, tgroup, gene_id, CAST(CAST(cents AS DOUBLE) / CAST(sum(cents) OVER (PARTITION BY draw, sample) AS DOUBLE) AS FLOAT) AS value FROM cube
), bycond AS (
  SELECT draw, condition, tid, tgroup, gene_id, sum(cents) AS cents FROM cube GROUP BY ALL
), cmean AS (
  SELECT draw, condition, tid, tgroup, gene_id, CAST(CAST(cents AS DOUBLE) / CAST(sum(cents) OVER (PARTITION BY draw, condition) AS DOUBLE) AS FLOAT) AS value FROM bycond
), cmu AS (
  SELECT draw, condition, tid, tgroup, gene_id, CAST(CAST(cents AS DOUBLE) / CAST(sum(cents) OVER (PARTITION BY draw, condition, tgroup) AS DOUBLE) AS FLOAT) AS value FROM bycond
), emu AS (
  SELECT draw, tid, tgroup, CAST(CAST(cents AS DOUBLE) / CAST(sum(cents) OVER (PARTITION BY draw, tgroup) AS DOUBLE) AS FLOAT) AS value
  FROM (SELECT draw, tid, tgroup, sum(cents) AS cents FROM cube GROUP BY ALL)
), rk AS (
  SELECT draw, sample, value, row_number() OVER (PARTITION BY draw, sample ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY draw, sample) AS n FROM quant
), anchor AS (
  SELECT draw, sample, CAST(value AS DOUBLE) AS a FROM rk WHERE r = n - least(n, 100000) + CAST(floor(0.9::DOUBLE * least(n, 100000)) AS BIGINT)
), scaling AS (
  SELECT x.draw, x.sample, y.a / x.a AS scale FROM anchor x JOIN anchor y ON y.draw = x.draw AND y.sample = 0
), names AS (
  SELECT gene_id, string_agg(transcript_id, ',' ORDER BY tid) AS transcript_ids FROM tr GROUP BY gene_id
), ft AS (
  SELECT CAST(i - 1 AS INTEGER) AS feature_id, p_type, nxt FROM (SELECT p_type, row_number() OVER (ORDER BY p_type) AS i,
    coalesce(lead(p_type) OVER (ORDER BY p_type), first_value(p_type) OVER (ORDER BY p_type)) AS nxt FROM (SELECT DISTINCT p_type FROM tr))
)"""

UNSCALED = "SELECT q.draw, q.sample, q.tid, q.tgroup, q.gene_id, CAST(q.value AS DOUBLE) / s.scale AS value FROM quant q JOIN scaling s ON s.draw = q.draw AND s.sample = q.sample"
Q_LOW, Q_HIGH = "(0.5::DOUBLE - 0.95::DOUBLE / 2)", "(0.5::DOUBLE + 0.95::DOUBLE / 2)"


def _rank(q: str) -> str:
    return f"CAST(round((n - 1) * {q}) AS BIGINT)"


def _summary(values: str, keys: str, names: str, factor: str, digits: int, clamp: bool, center: str = "mean", tail: str = "") -> str:
    """names: select list over s (the summary) and what ``tail`` joins."""
    middle = "avg(value)" if center == "mean" else "max(CASE WHEN r = n // 2 THEN value END)"
    lo = f"max(CASE WHEN r = {_rank(Q_LOW)} THEN value END)"
    hi = f"max(CASE WHEN r = {_rank(Q_HIGH)} THEN value END)"
    if clamp:
        lo, hi = f"least({lo}, {middle})", f"greatest({hi}, {middle})"
    out = lambda x, n: f"round(({x}) * {factor}, {digits}) + 0.0 AS {n}"
    return f"""WITH {CUBE}, v AS ({values}), o AS (
  SELECT {keys}, value, row_number() OVER (PARTITION BY {keys} ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY {keys}) AS n FROM v
), s AS (SELECT {keys}, {out(middle, "estimate")}, {out(lo, "lower")}, {out(hi, "upper")} FROM o GROUP BY {keys})
SELECT {names}, s.estimate, s.lower, s.upper FROM s {tail}"""


def _pairs(values: str, key: str, change: str, up: str, down: str, names: str, tail: str) -> str:
    """values: (draw, condition, key, value) as doubles; change over x and y."""
    return f"""WITH {CUBE}, v AS ({values}), c AS (
  SELECT x.{key} AS k, x.condition AS condition_a, y.condition AS condition_b, {change} AS d
  FROM v x JOIN v y ON x.{key} = y.{key} AND x.draw = y.draw AND x.condition < y.condition
), o AS (
  SELECT *, row_number() OVER (PARTITION BY k, condition_a, condition_b ORDER BY d) - 1 AS r, count(*) OVER (PARTITION BY k, condition_a, condition_b) AS n FROM c
), s AS (
  SELECT k, condition_a, condition_b, round(avg(CASE WHEN {down} THEN 1.0::DOUBLE ELSE 0 END), 6) + 0.0 AS down_pr, round(avg(CASE WHEN {up} THEN 1.0::DOUBLE ELSE 0 END), 6) + 0.0 AS up_pr,
         round(max(CASE WHEN r = n // 2 THEN d END), 6) + 0.0 AS median_change,
         round(max(CASE WHEN r = {_rank(Q_LOW)} THEN d END), 6) + 0.0 AS lower_change, round(max(CASE WHEN r = {_rank(Q_HIGH)} THEN d END), 6) + 0.0 AS upper_change
  FROM o GROUP BY k, condition_a, condition_b
) SELECT {names}, s.condition_a, s.condition_b, s.down_pr, s.up_pr, s.median_change, s.lower_change, s.upper_change FROM s {tail}"""


TRN = "JOIN tr ON tr.tid = s.tid"
DOUBLES = "CAST(value AS DOUBLE) AS value"
SQL["transcript_expression"] = _summary(UNSCALED, "sample, tid", "s.sample, s.tid, tr.gene_id, tr.transcript_id", "1e6", 4, True, tail=TRN)
SQL["transcript_expression_normalized"] = _summary(f"SELECT sample, tid, draw, {DOUBLES} FROM quant", "sample, tid", "s.sample, s.tid, tr.gene_id, tr.transcript_id", "1e6", 4, True, tail=TRN)
SQL["transcript_splicing"] = _summary(
    "SELECT draw, sample, tid, value FROM (SELECT draw, sample, tid, CAST(value AS DOUBLE) / sum(CAST(value AS DOUBLE)) OVER w AS value, count(*) OVER w AS m FROM quant WINDOW w AS (PARTITION BY draw, sample, tgroup)) WHERE m > 1",
    "sample, tid", "s.sample, s.tid, tr.transcript_id", "1.0", 6, True, tail=TRN,
)
SQL["gene_expression"] = _summary(
    f"SELECT draw, sample, gene_id, sum(value) AS value FROM ({UNSCALED}) GROUP BY ALL", "sample, gene_id", "s.sample, s.gene_id, s.gene_id AS gene_name, names.transcript_ids", "1e6", 4, True, tail="JOIN names ON names.gene_id = s.gene_id"
)
SQL["feature_expression"] = _summary(
    f"SELECT u.draw, u.sample, ft.feature_id, sum(u.value) AS value FROM ({UNSCALED}) u JOIN tr ON tr.tid = u.tid JOIN ft ON ft.p_type = tr.p_type GROUP BY ALL", "sample, feature_id", "s.sample, s.feature_id", "1e6", 4, True
)
SQL["condition_transcript_expression"] = _summary(f"SELECT draw, condition, tid, {DOUBLES} FROM cmean", "condition, tid", "s.condition, s.tid, tr.transcript_id", "1e6", 4, False, tail=TRN)
GENE_MEAN = "SELECT draw, condition, gene_id, sum(CAST(value AS DOUBLE)) AS value FROM cmean GROUP BY ALL"
SQL["condition_gene_expression"] = _summary(GENE_MEAN, "condition, gene_id", "s.condition, s.gene_id, names.transcript_ids", "1e6", 4, False, tail="JOIN names ON names.gene_id = s.gene_id")
SQL["condition_feature_expression"] = _summary(
    "SELECT c.draw, c.condition, ft.feature_id, sum(CAST(c.value AS DOUBLE)) AS value FROM cmean c JOIN tr ON tr.tid = c.tid JOIN ft ON ft.p_type = tr.p_type GROUP BY ALL", "condition, feature_id", "s.condition, s.feature_id", "1e6", 4, False
)
FOLD = "log2(x.value / y.value)"
KTR = "JOIN tr ON tr.tid = s.k"
SQL["diff_transcript"] = _pairs(f"SELECT draw, condition, tid, {DOUBLES} FROM cmean", "tid", FOLD, "d >= 1.0", "d <= -1.0", "s.k AS tid, tr.transcript_id", KTR)
SQL["diff_gene"] = _pairs(GENE_MEAN, "gene_id", FOLD, "d >= 0.5", "d <= -0.5", "s.k AS gene_id, names.transcript_ids", "JOIN names ON names.gene_id = s.k")
SQL["diff_group"] = _pairs(
    "SELECT c.draw, c.condition, tr.p_type AS grp, sum(CAST(c.value AS DOUBLE)) AS value FROM cmean c JOIN tr ON tr.tid = c.tid GROUP BY ALL", "grp", FOLD, "d >= 0.25", "d <= -0.25",
    's.k AS "group", g.gene_ids, g.transcript_ids', "JOIN (SELECT p_type, string_agg(DISTINCT gene_id, ',' ORDER BY gene_id) AS gene_ids, string_agg(transcript_id, ',' ORDER BY tid) AS transcript_ids FROM tr GROUP BY p_type) g ON g.p_type = s.k",
)
MU = "SELECT draw, condition, tid, least(greatest(CAST(value AS DOUBLE), 0), 1) AS value FROM cmu"
SQL["diff_splicing"] = _pairs(MU, "tid", "x.value - y.value", "abs(d) >= 0.1 AND d > 0", "abs(d) >= 0.1 AND d <= 0", "s.k AS tid, tr.tgroup, tr.transcript_id", KTR)
SQL["condition_splicing"] = _summary(MU, "condition, tid", "s.condition, s.tid, tr.tgroup, tr.transcript_id", "1.0", 6, False, "median", TRN)
SQL["experiment_splicing"] = _summary(f"SELECT draw, tid, {DOUBLES} FROM emu", "tid", "s.tid, tr.tgroup, tr.transcript_id", "1.0", 6, False, "median", TRN)
SQL["pairwise_splicing"] = f"""WITH {CUBE}, c AS (
  SELECT x.tid, x.condition AS condition_a, y.condition AS condition_b, log2(CAST(x.value AS DOUBLE)) - log2(CAST(y.value AS DOUBLE)) AS d
  FROM cmu x JOIN cmu y ON x.tid = y.tid AND x.draw = y.draw AND x.condition <> y.condition
), o AS (SELECT *, row_number() OVER (PARTITION BY tid, condition_a, condition_b ORDER BY d) - 1 AS r, count(*) OVER (PARTITION BY tid, condition_a, condition_b) AS n FROM c)
SELECT tid, condition_a, condition_b, round(max(CASE WHEN r = CAST(floor(n * 0.05::DOUBLE) AS BIGINT) THEN d END), 6) + 0.0 AS lower, round(max(CASE WHEN r = CAST(floor(n * 0.95::DOUBLE) AS BIGINT) THEN d END), 6) + 0.0 AS upper
FROM o GROUP BY tid, condition_a, condition_b"""
RATES = """
mem AS (SELECT ft.feature_id, tr.tid, tr.tgroup, 1 AS inc FROM ft JOIN tr ON tr.p_type = ft.p_type UNION ALL SELECT ft.feature_id, tr.tid, tr.tgroup, 0 FROM ft JOIN tr ON tr.p_type = ft.nxt),
used AS (SELECT feature_id, tgroup FROM mem GROUP BY ALL HAVING count(DISTINCT inc) = 2),
tot AS (SELECT draw, condition, tgroup, sum(CAST(value AS DOUBLE)) AS m FROM cmean GROUP BY ALL),
part_ AS (
  SELECT mem.feature_id, mem.inc, c.draw, c.condition, sum(least(greatest(CAST(c.value AS DOUBLE), 0), 1) * tot.m) / sum(tot.m) AS w
  FROM mem JOIN used ON used.feature_id = mem.feature_id AND used.tgroup = mem.tgroup JOIN cmu c ON c.tid = mem.tid
  JOIN tot ON tot.draw = c.draw AND tot.condition = c.condition AND tot.tgroup = mem.tgroup GROUP BY ALL
),
rate AS (SELECT i.feature_id, i.draw, i.condition, i.w / (i.w + e.w) AS value FROM part_ i JOIN part_ e ON e.feature_id = i.feature_id AND e.draw = i.draw AND e.condition = i.condition AND i.inc = 1 AND e.inc = 0)"""
SQL["feature_splicing"] = _pairs("SELECT * FROM rate", "feature_id", "x.value - y.value", "abs(d) >= 0.05 AND d > 0", "abs(d) >= 0.05 AND d <= 0", "s.k AS feature_id", "").replace(f"WITH {CUBE},", f"WITH {CUBE}, {RATES},")
SQL["feature_splicing_samples"] = f"""WITH {CUBE}, {RATES}
SELECT feature_id, condition, CAST(row_number() OVER (PARTITION BY feature_id, condition ORDER BY draw) - 1 AS INTEGER) AS round, round(value, 6) AS rate FROM rate"""
SQL["trace"] = f"""WITH {CUBE}, one AS (SELECT tid FROM tr WHERE transcript_id = (SELECT min(transcript_id) FROM tr))
SELECT draw + 1 AS round, -1 AS condition, round(CAST(value AS DOUBLE), 6) + 0.0 AS value FROM emu WHERE tid IN (FROM one)
UNION ALL SELECT draw + 1, condition, round(CAST(value AS DOUBLE), 6) + 0.0 FROM cmu WHERE tid IN (FROM one)"""
SQL["describe"] = f"""WITH {CUBE} SELECT (SELECT count(*) FROM sm) AS n_samples, (SELECT count(DISTINCT condition) FROM sm) AS n_conditions, (SELECT count(*) FROM tr) AS n_transcripts,
  (SELECT count(DISTINCT gene_id) FROM tr) AS n_genes, (SELECT count(DISTINCT tgroup) FROM tr) AS n_tgroups"""
SQL["expression_samples"] = f"""WITH {CUBE} SELECT sample, tid, string_agg(CAST(CAST(round(CAST(value AS DOUBLE) * 1e9) AS BIGINT) AS VARCHAR), ',' ORDER BY draw) AS samples FROM quant GROUP BY sample, tid"""
SQL["monotone_order"] = f"""WITH {CUBE}, k AS (SELECT tid, draw, string_agg(CAST(condition AS VARCHAR), '<' ORDER BY value, condition) AS ordering FROM cmu GROUP BY tid, draw),
n AS (SELECT tid, ordering, count(*) AS n FROM k GROUP BY tid, ordering), f AS (SELECT tid, ordering, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY tid) AS f FROM n)
SELECT tid, ordering, round(f, 6) + 0.0 AS frequency FROM f WHERE f > 0.25"""
SQL["switch_divergence"] = f"""WITH {CUBE}, k AS (
  SELECT x.tgroup, x.condition AS condition_a, y.condition AS condition_b, x.draw, sum((CAST(x.value AS DOUBLE) - CAST(y.value AS DOUBLE)) * (log2(CAST(x.value AS DOUBLE)) - log2(CAST(y.value AS DOUBLE)))) AS d
  FROM cmu x JOIN cmu y ON y.tid = x.tid AND y.draw = x.draw AND x.condition < y.condition GROUP BY ALL
), o AS (SELECT *, row_number() OVER (PARTITION BY tgroup, condition_a, condition_b ORDER BY d) - 1 AS r, count(*) OVER (PARTITION BY tgroup, condition_a, condition_b) AS n FROM k)
SELECT tgroup, condition_a, condition_b, round(max(CASE WHEN r = n // 2 THEN d END), 6) + 0.0 AS divergence FROM o GROUP BY ALL"""
SQL["quantile_normalization"] = f"WITH {CUBE} SELECT draw, sample, round(scale, 9) + 0.0 AS scale FROM scaling"
SQL["most_abundant"] = f"""WITH {CUBE}, t AS (SELECT sample, tid, CAST(sum(cents) AS BIGINT) AS cents FROM cube GROUP BY ALL)
SELECT sample, rank, tid, cents FROM (SELECT *, CAST(row_number() OVER (PARTITION BY sample ORDER BY cents DESC, tid) AS INTEGER) AS rank FROM t) WHERE rank <= 10"""
SQL["tid_assignment"] = f"WITH {CUBE} SELECT transcript_id, tid FROM tr"
SQL["tgroup_dense_rank"] = f"WITH {CUBE} SELECT transcript_id, tgroup FROM tr"
SQL["spliced_tgroups"] = f"WITH {CUBE} SELECT tgroup, count(*) AS n, CAST(row_number() OVER (ORDER BY tgroup) - 1 AS INTEGER) AS spliced FROM tr GROUP BY tgroup HAVING count(*) > 1"
SQL["natural_sort"] = f"SELECT seqname, CAST(row_number() OVER (ORDER BY {NUMBER.format('seqname')}, seqname) AS INTEGER) AS place FROM (SELECT DISTINCT s_name AS seqname FROM supplier)"

SECONDS = "CAST(floor(epoch(ts)) AS BIGINT)"
SQL["tss_cluster"] = f"""WITH e AS (SELECT user_id, event_id, {SECONDS} AS sec FROM events),
g AS (SELECT *, CASE WHEN sec - lag(sec) OVER (PARTITION BY user_id ORDER BY sec, event_id) <= 3600 THEN 0 ELSE 1 END AS o FROM e),
c AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING) - 1 AS cluster FROM g)
SELECT user_id, CAST(cluster AS BIGINT) AS cluster, count(*) AS n, min(sec) AS first_at, max(sec) AS last_at FROM c GROUP BY user_id, cluster"""

DAY = "CAST(date_diff('day', TIMESTAMP '1992-01-01', l_shipdate) AS INTEGER)"
IV = f'iv AS (SELECT l_suppkey AS seqname, {DAY} AS s, {DAY} + CAST(l_quantity AS INTEGER) AS e FROM lineitem)'
BEFORE = "max(e) OVER (PARTITION BY seqname ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
SQL["locus_grouping"] = f"""WITH {IV}, b AS (SELECT *, {BEFORE} AS p FROM iv), c AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p THEN 1 ELSE 0 END) OVER (PARTITION BY seqname ORDER BY s, e ROWS UNBOUNDED PRECEDING) - 1 AS locus FROM b)
SELECT seqname, CAST(locus AS BIGINT) AS locus, count(*) AS n, min(s) AS min_start, max(e) AS max_end FROM c GROUP BY seqname, locus"""
SQL["interval_union"] = f"""WITH {IV}, day_ AS (SELECT DISTINCT seqname, unnest(range(s, e + 1)) AS d FROM iv), i AS (SELECT seqname, d, d - row_number() OVER (PARTITION BY seqname ORDER BY d) AS g FROM day_)
SELECT seqname, CAST(min(d) AS INTEGER) AS start, CAST(max(d) AS INTEGER) AS "end" FROM i GROUP BY seqname, g"""
SQL["intergenic_gaps"] = f"""WITH {IV}, day_ AS (SELECT DISTINCT seqname, unnest(range(s, e + 1)) AS d FROM iv), n AS (SELECT seqname, d, lead(d) OVER (PARTITION BY seqname ORDER BY d) AS x FROM day_)
SELECT seqname, CAST(d + 1 AS INTEGER) AS start, CAST(x - 1 AS INTEGER) AS "end" FROM n WHERE x > d + 1"""
SQL["consensus_segments"] = f"""WITH {IV}, b AS (SELECT seqname, s AS p FROM iv UNION SELECT seqname, e + 1 FROM iv), n AS (SELECT seqname, p, lead(p) OVER (PARTITION BY seqname ORDER BY p) AS x FROM b)
SELECT n.seqname, n.p AS start, n.x - 1 AS "end", count(*) AS depth FROM n JOIN iv ON iv.seqname = n.seqname AND iv.s <= n.p AND iv.e >= n.p WHERE n.x IS NOT NULL GROUP BY ALL"""
SQL["introns_flanks"] = f"""WITH x AS (SELECT l_partkey AS tid, {DAY} AS s, {DAY} + l_linenumber AS e FROM lineitem), n AS (SELECT tid, e + 1 AS start, lead(s) OVER (PARTITION BY tid ORDER BY s, e) - 1 AS "end" FROM x)
SELECT * FROM n WHERE "end" >= start"""
EXON = """ex AS (SELECT DISTINCT l_orderkey AS tid, 'chr' || CAST(l_orderkey % 5 AS VARCHAR) AS seqname, CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, l_partkey % 12 * 100 AS s,
  l_partkey % 12 * 100 + CASE WHEN l_linenumber = 7 THEN 140 ELSE 40 END AS e FROM lineitem),
nx AS (SELECT *, lag(e) OVER w AS pe, lead(s) OVER w AS ns, lead(e) OVER w AS ne FROM ex WINDOW w AS (PARTITION BY seqname, strand, tid ORDER BY s, e))"""
FEATURE = """SELECT a.seqname, a.strand, a.s AS start, a.e AS "end", a.ls AS link_start, a.le AS link_end, CAST({inc}.n AS INTEGER) AS n_including, CAST({exc}.n AS INTEGER) AS n_excluding, {inc}.t AS first_including
FROM a JOIN b ON b.seqname = a.seqname AND b.strand = a.strand AND b.ls = a.ls AND b.le = a.le"""
SQL["cassette_features"] = f"""WITH {EXON}, a AS (SELECT seqname, strand, s, e, pe + 1 AS ls, ns - 1 AS le, count(DISTINCT tid) AS n, min(tid) AS t FROM nx WHERE pe IS NOT NULL AND ns IS NOT NULL GROUP BY ALL),
b AS (SELECT seqname, strand, e + 1 AS ls, ns - 1 AS le, count(DISTINCT tid) AS n, min(tid) AS t FROM nx WHERE ns - 1 >= e + 1 GROUP BY ALL) {FEATURE.format(inc="a", exc="b")}"""
SQL["retained_features"] = f"""WITH {EXON}, a AS (SELECT seqname, strand, e + 1 AS s, ns - 1 AS e, s AS ls, ne AS le, count(DISTINCT tid) AS n, min(tid) AS t FROM nx WHERE ns - 1 >= e + 1 GROUP BY seqname, strand, nx.e, nx.ns, nx.s, nx.ne),
b AS (SELECT seqname, strand, s AS ls, e AS le, count(DISTINCT tid) AS n, min(tid) AS t FROM ex GROUP BY ALL) {FEATURE.format(inc="b", exc="a")}"""
SQL["gene_end_exons"] = f"""WITH {EXON}, k AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY s, e) AS i, row_number() OVER (PARTITION BY tid ORDER BY s DESC, e DESC) AS j FROM ex),
g AS (SELECT tid, min(strand) AS strand, max(CASE WHEN i = 1 THEN s END) AS ls, max(CASE WHEN i = 1 THEN e END) AS le, max(CASE WHEN j = 1 THEN s END) AS hs, max(CASE WHEN j = 1 THEN e END) AS he FROM k GROUP BY tid)
SELECT tid AS gene_id, CASE WHEN strand = '-' THEN hs ELSE ls END AS five_start, CASE WHEN strand = '-' THEN he ELSE le END AS five_end, CASE WHEN strand = '-' THEN ls ELSE hs END AS three_start, CASE WHEN strand = '-' THEN le ELSE he END AS three_end FROM g"""
SQL["utr_intervals"] = f"""WITH {EXON}, k AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY s, e) AS i, row_number() OVER (PARTITION BY tid ORDER BY s DESC, e DESC) AS j FROM ex)
SELECT DISTINCT seqname, strand, s AS start, e AS "end" FROM k WHERE (strand = '-' AND i = 1) OR (strand <> '-' AND j = 1)"""
SQL["transcript_offsets"] = f"""WITH {EXON} SELECT a.tid, a.s AS start, a.e AS "end", CAST(coalesce(sum(b.e - b.s + 1), 0) AS BIGINT) AS "offset"
FROM ex a LEFT JOIN ex b ON b.tid = a.tid AND (b.s, b.e) < (a.s, a.e) GROUP BY ALL"""
SQL["three_prime_distance"] = f"""WITH {EXON}, t AS (SELECT tid, strand, s, e, row_number() OVER (PARTITION BY tid ORDER BY s, e) AS i FROM ex),
m AS (SELECT *, sum(e - s + 1) OVER (PARTITION BY tid) AS tot, sum(e - s + 1) OVER (PARTITION BY tid ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS upto FROM t),
x AS (SELECT tid, CASE WHEN strand = '-' THEN upto - (e - s + 1) ELSE tot - upto END AS d FROM m)
SELECT tid, CAST(max(d) AS BIGINT) AS most, CAST(sum(d) AS BIGINT) AS total FROM x GROUP BY tid"""
EV = f"ev AS (SELECT user_id, event_id, event_type, {SECONDS} AS sec FROM events)"
SQL["interval_containment"] = f"WITH {EV} SELECT w.event_id AS window_id, p.event_id AS event_id FROM ev p JOIN ev w ON w.user_id = p.user_id AND w.event_type = 'purchase' AND p.sec BETWEEN w.sec AND w.sec + 21600"
SQL["interval_overlap"] = f"""WITH {EV} SELECT a.event_id AS view_id, b.event_id AS click_id FROM ev a JOIN ev b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' AND a.sec <= b.sec + 7200 AND b.sec <= a.sec + 3600"""
SQL["bounded_asof"] = f"""WITH {EV}, s AS (SELECT user_id, sec, max(event_id) AS signup FROM ev WHERE event_type = 'signup' GROUP BY user_id, sec)
SELECT e.event_id, s.signup AS signup_id FROM ev e ASOF LEFT JOIN s ON s.user_id = e.user_id AND s.sec <= e.sec"""
LAG = "lg AS (SELECT CAST(abs(date_diff('day', o_orderdate, l_shipdate)) AS INTEGER) AS length, l_linestatus FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"
HIST = f"{LAG}, h AS (SELECT length, count(*) AS c FROM lg WHERE length > 0 AND length <= 1000 GROUP BY length)"
SQL["position_tally"] = f"SELECT l_suppkey AS seqname, l_linestatus AS strand, {DAY} AS pos, min(l_orderkey) AS interval_id, count(*) AS count FROM lineitem GROUP BY ALL"
SQL["fragment_histogram"] = f"WITH {HIST} SELECT length, c AS count FROM h"
SQL["emp_dist"] = f"""WITH {HIST}, u AS (SELECT length, c, sum(c) OVER (ORDER BY length) AS upto, sum(c) OVER () AS tot FROM h), k AS (SELECT * FROM u WHERE upto - c < (1 - 0.001::DOUBLE) * tot)
SELECT length, round(CAST(c AS DOUBLE) / sum(c) OVER (), 9) + 0.0 AS pdf, round(CAST(upto AS DOUBLE) / sum(c) OVER (), 9) + 0.0 AS cdf FROM k"""
SQL["weighted_median"] = f"WITH {HIST}, u AS (SELECT length, sum(c) OVER (ORDER BY length) AS upto, sum(c) OVER () AS tot FROM h) SELECT min(length) AS median FROM u WHERE 2 * upto >= tot"
SQL["strand_entropy"] = f"""WITH {LAG}, p AS (SELECT CAST(count(*) FILTER (WHERE l_linestatus = 'F') AS DOUBLE) / count(*) AS p FROM lg)
SELECT round(p, 9) + 0.0 AS specificity, round(p * ln(p) + (1 - p) * ln(1 - p), 9) + 0.0 AS negentropy FROM p"""
SQL["unique_fragment_counts"] = "SELECT l_suppkey, l_linenumber, l_quantity, l_discount, count(*) AS count FROM lineitem GROUP BY ALL"
OB = "ob AS (SELECT l_orderkey, l_partkey, p_brand, l_quantity, l_extendedprice FROM lineitem JOIN part ON p_partkey = l_partkey)"
SQL["gene_counts"] = f"""WITH {OB}, u AS (SELECT l_orderkey, min(p_brand) AS b FROM ob GROUP BY l_orderkey HAVING count(DISTINCT p_brand) = 1)
SELECT g.p_brand AS gene_id, count(u.b) AS count FROM (SELECT DISTINCT p_brand FROM part) g LEFT JOIN u ON u.b = g.p_brand GROUP BY g.p_brand"""
SQL["mate_counts"] = "SELECT l_orderkey AS qname, count(*) FILTER (WHERE l_linestatus = 'F') AS mate1, count(*) FILTER (WHERE l_linestatus <> 'F') AS mate2 FROM lineitem GROUP BY l_orderkey"
WT = f"{OB}, wt AS (SELECT p_brand AS tid, l_orderkey AS read, l_partkey AS seq, l_quantity AS w, CAST(round(l_extendedprice * 100) AS BIGINT) AS align_pr FROM ob)"
SQL["best_alignment"] = f"""WITH {WT}, r AS (SELECT *, row_number() OVER (PARTITION BY tid, read ORDER BY w * align_pr DESC, seq, w DESC, align_pr DESC) AS i FROM wt) SELECT tid, read, w, align_pr, seq FROM r WHERE i = 1"""
SQL["align_prune"] = f"""WITH {WT}, m AS (SELECT read, tid, max(align_pr) AS align_pr FROM wt GROUP BY ALL), s AS (SELECT *, CAST(align_pr AS DOUBLE) / CAST(sum(align_pr) OVER (PARTITION BY read) AS DOUBLE) AS share FROM m)
SELECT read, tid, align_pr, round(share, 9) + 0.0 AS share FROM s WHERE share >= 0.1"""
SQL["align_sums"] = f"WITH {WT}, m AS (SELECT read, tid, max(align_pr) AS p FROM wt GROUP BY ALL) SELECT read, CAST(sum(p) AS BIGINT) AS align_sum FROM m GROUP BY read"
SQL["connected_components"] = """WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey * 2 AS a, l_partkey * 2 + 1 AS b FROM lineitem), l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(node, component) USING KEY (node) AS (SELECT a, min(least(a, b)) FROM l GROUP BY a
  UNION SELECT l.b, min(r.component) FROM r JOIN l ON l.a = r.node JOIN recurring.r AS o ON o.node = l.b WHERE r.component < o.component GROUP BY l.b)
SELECT node, component FROM r"""
SQL["connected_components_of_all_lines"] = SQL["connected_components"]
SQ = "sq AS (SELECT doc_id, lang, regexp_replace(lower(text), '[^acgt]', '', 'g') AS s FROM documents)"
SQL["gc_content"] = f"WITH {SQ} SELECT doc_id, CAST(length(s) AS INTEGER) AS bases, CAST(length(replace(replace(s, 'a', ''), 't', '')) AS INTEGER) AS gc FROM sq"
SQL["gc_bias_bins"] = f"""WITH {SQ}, f AS (SELECT lang IS NOT DISTINCT FROM 'en' AS en, CAST(length(replace(replace(s, 'a', ''), 't', '')) AS DOUBLE) / length(s) AS gc FROM sq WHERE length(s) > 0),
u AS (SELECT unnest([0.29, 0.32, 0.35, 0.37, 0.39, 0.41, 0.43, 0.45, 0.48, 0.51, 0.53, 0.57, 0.60, 0.64, 1.00]::DOUBLE[]) AS up, unnest(range(15)) AS bin),
b AS (SELECT f.en, min(u.bin) AS bin FROM (SELECT *, row_number() OVER () AS i FROM f) f JOIN u ON f.gc <= u.up GROUP BY f.en, f.i), s AS (SELECT en, bin, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY en) AS p FROM b GROUP BY en, bin),
j AS (SELECT bin, coalesce(max(p) FILTER (WHERE en), 0) AS fore, coalesce(max(p) FILTER (WHERE NOT en), 0) AS back FROM s GROUP BY bin)
SELECT CAST(bin AS INTEGER) AS bin, round(fore, 9) + 0.0 AS fore, round(back, 9) + 0.0 AS back, round(CASE WHEN back > 0 THEN least(greatest(fore / back, 0.01), 100) ELSE 1 END, 9) + 0.0 AS bias FROM j"""
SQL["revcomp"] = f"WITH {SQ} SELECT doc_id, md5(reverse(translate(s, 'acgt', 'tgca'))) AS revcomp_md5 FROM sq"


def _kmers(k: int) -> str:
    return f"{SQ}, km AS (SELECT lang, (i - 1) % 7 AS pos, substr(s, i, {k}) AS kmer FROM (SELECT lang, s, unnest(range(1, length(s) - {k} + 2)) AS i FROM sq))"


SQL["kmer_counts"] = f"""WITH {_kmers(4)}, c AS (SELECT kmer, count(*) AS count FROM km GROUP BY kmer)
SELECT kmer, CAST(64 * (instr('acgt', kmer[1]) - 1) + 16 * (instr('acgt', kmer[2]) - 1) + 4 * (instr('acgt', kmer[3]) - 1) + instr('acgt', kmer[4]) - 1 AS BIGINT) AS number, count FROM c"""
SQL["kmer_conditional"] = f"""WITH {_kmers(3)}, c AS (SELECT CAST(pos AS INTEGER) AS pos, kmer, count(*) AS count FROM km GROUP BY ALL)
SELECT pos, kmer, count, round(CAST(count AS DOUBLE) / sum(count) OVER (PARTITION BY pos, left(kmer, 2)), 9) + 0.0 AS p FROM c"""
SQL["js_divergence"] = f"""WITH {_kmers(2)}, n AS (SELECT lang IS NOT DISTINCT FROM 'en' AS en, CAST(pos AS INTEGER) AS pos, kmer, count(*) AS n FROM km GROUP BY ALL), c AS (SELECT en, pos, kmer, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY en, pos) AS p FROM n)
SELECT a.pos, round(sum((a.p - b.p) * (log2(a.p) - log2(b.p))), 9) + 0.0 AS divergence FROM c a JOIN c b ON a.en AND NOT b.en AND a.pos = b.pos AND a.kmer = b.kmer GROUP BY a.pos"""
SQL["rolling_gc"] = """WITH g AS (SELECT l_suppkey AS tid, l_orderkey AS pos, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS gc FROM lineitem GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY pos) AS i FROM g)
SELECT a.tid, a.pos, CAST(sum(b.gc) AS BIGINT) AS gc_count FROM n a JOIN n b ON b.tid = a.tid AND b.i BETWEEN a.i - 4 AND a.i GROUP BY a.tid, a.pos"""
SQL["attribute_map"] = "SELECT p_partkey, p_brand AS gene_id, CAST(p_size AS VARCHAR) AS size, p_name AS name, CAST(NULL AS VARCHAR) AS missing FROM part"
SQL["locus_format"] = f"""WITH u AS ({SQL["interval_union"]}) SELECT CAST(seqname AS VARCHAR) || ':' || CAST(start AS VARCHAR) || '-' || CAST("end" AS VARCHAR) || '(+)' AS locus FROM u"""
SQL["cigar_ops"] = """WITH c AS (SELECT DISTINCT l_orderkey, l_linenumber AS s, CAST(l_quantity AS INTEGER) AS m, l_suppkey % 50 + 1 AS n, l_partkey % 30 + 1 AS m2 FROM lineitem)
SELECT l_orderkey, concat(s, 'S', m, 'M', n, 'N', m2, 'M') AS cigar, 4 AS n_ops, l_orderkey - s AS true_pos, l_orderkey + m + n + m2 AS true_end, l_orderkey + m + n + m2 AS ref_end FROM c"""
SQL["embedding_dot"] = """SELECT a.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) + 0.0 AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
