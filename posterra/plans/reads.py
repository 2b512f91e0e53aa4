"""More of the catalogue: sources, alignments, fragments and weights over the driver's tables, each with its SQL beside it.

Lines of GTF, BED, FASTA and SAM are written from the star schema and parsed again, so that
the statements say what the parsed fields must be.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cigar, seq
from ..model import bias, densities, weights
from ..operators import annotation, components, fragments, intervals, scaling
from ..sources import alignments, annotation as sources
from . import analog, oracles, registry, summaries
from .catalog import LEVEL, _exons, _lags, _rounded, _weights

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


# --- sources ------------------------------------------------------------------------------------


@query(
    f"""WITH {oracles.EXON}, t AS (SELECT tid, 'T' || CAST(tid AS VARCHAR) AS transcript_id FROM ex)
SELECT DISTINCT 'T' || CAST(tid AS VARCHAR) AS transcript_id, 'G' || CAST(tid // 3 AS VARCHAR) AS gene_id, 'name of ' || CAST(tid // 3 AS VARCHAR) AS gene_name, seqname, strand, s AS start, e AS "end" FROM ex"""
)
def gtf_exons(spark, d):
    """Annotation lines with comments, gene rows and rows without a transcript among them, to exons."""
    ex = _exons(spark, d)
    gene = F.floor(F.col("tid") / 3).cast("string")
    named = F.format_string('gene_id "G%s"; transcript_id "T%s"; gene_name "name of %s"; level 2;', gene, F.col("tid").cast("string"), gene)
    line = lambda feature, attributes: F.concat_ws("\t", "seqname", F.lit("made"), F.lit(feature), (F.col("start") + 1).cast("string"), (F.col("end") + 1).cast("string"), F.lit("."), "strand", F.lit("."), attributes)
    made = F.array(line("exon", named), line("CDS", named), line("gene", named), line("exon", F.format_string('gene_id "G%s";', gene)), F.lit("# a comment"), F.lit(""))
    rows = sources.exons(sources.parse_gtf(ex.select(F.explode(made).alias("value"))))
    return rows.select("transcript_id", "gene_id", "gene_name", "seqname", "strand", "start", "end")


@query("""WITH i AS (SELECT 'i' || CAST(p_partkey AS VARCHAR) AS name, p_partkey % 500 AS a, p_partkey % 500 + 100 AS b, p_partkey % 500 + 110 + p_size AS c, p_partkey % 500 + 300 AS d FROM part)
SELECT name || '-included' AS transcript_id, name AS gene_id, greatest(a - 200, 0) AS start, a - 1 AS "end" FROM i
UNION ALL SELECT name || '-included', name, b, c - 1 FROM i UNION ALL SELECT name || '-included', name, d, d + 199 FROM i
UNION ALL SELECT name || '-excluded', name, greatest(a - 200, 0), a - 1 FROM i UNION ALL SELECT name || '-excluded', name, d, d + 199 FROM i""")
def bed_introns(spark, d):
    """Two introns a part to the transcripts with and without the exon between."""
    part = analog.table(spark, d, "part").select(F.concat(F.lit("i"), F.col("p_partkey").cast("string")).alias("name"), (F.col("p_partkey") % 500).alias("at"), "p_size")
    intron = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))
    both = F.array(intron(F.col("at") + 110 + F.col("p_size"), F.col("at") + 300), intron(F.col("at"), F.col("at") + 100))
    rows = part.select(F.lit("chr1").alias("seqname"), "name", F.lit("+").alias("strand"), F.inline(both))
    return sources.intron_transcripts(rows).select("transcript_id", "gene_id", "start", "end")


@query("""SELECT 'p' || CAST(p_partkey AS VARCHAR) AS seqname, upper(replace(p_name || p_type, ' ', '')) AS seq FROM part""")
def fasta_records(spark, d):
    """Records with a description and sequences over several lines."""
    part = analog.table(spark, d, "part").select(F.format_string("p%s some words\n%s\n%s\n", F.col("p_partkey").cast("string"), "p_name", "p_type").alias("value"))
    return sources.parse_fasta(part)


def _sam_lines(spark, d):
    x = lambda c: F.col(c).cast("long").cast("string")
    flag = F.when(F.col("l_linestatus") == "F", 65).otherwise(129) + F.when(F.col("l_returnflag") == "R", 16).otherwise(0) + F.when(F.col("l_linenumber") == 7, 4).otherwise(0) + F.when(F.col("l_linenumber") % 2 == 0, 2).otherwise(0)
    return analog.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat_ws(
            "\t", F.concat(F.lit("r"), x("l_orderkey")), F.when(F.col("l_linenumber") == 6, F.concat(F.lit("0x"), F.hex(flag))).otherwise(flag.cast("string")), F.concat(F.lit("chr"), (F.col("l_suppkey") % 5).cast("string")),
            x("l_partkey"), x("l_linenumber"), F.concat(x("l_quantity"), F.lit("M")), F.lit("="), (F.col("l_partkey") + 7).cast("string"), (-F.col("l_linenumber")).cast("string"), F.lit("*"), F.lit("*"),
            F.concat(F.lit("NM:i:"), (F.col("l_linenumber") % 4).cast("string")), F.concat(F.lit("HI:i:"), x("l_suppkey")), F.lit("MD:Z:5A^CG3T0"),
        ).alias("value")
    )


SAM = """sam AS (SELECT 'r' || CAST(l_orderkey AS VARCHAR) AS qname, CAST((CASE WHEN l_linestatus = 'F' THEN 65 ELSE 129 END) + (CASE WHEN l_returnflag = 'R' THEN 16 ELSE 0 END) + (CASE WHEN l_linenumber = 7 THEN 4 ELSE 0 END) + (CASE WHEN l_linenumber % 2 = 0 THEN 2 ELSE 0 END) AS INTEGER) AS flag,
  'chr' || CAST(l_suppkey % 5 AS VARCHAR) AS rname, l_partkey - 1 AS pos, l_linenumber AS mapq, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || 'M' AS cigar, l_partkey + 6 AS pnext, CAST(-l_linenumber AS BIGINT) AS tlen,
  CAST(l_linenumber % 4 AS INTEGER) AS nm, CAST(l_suppkey AS VARCHAR) AS hi FROM lineitem)"""


@query(f"WITH {SAM} SELECT qname, flag, rname, pos, mapq, cigar, rname AS rnext, pnext, tlen, '*' AS seq, nm, hi, 2 AS by_md FROM sam")
def sam_records(spark, d):
    """Every field of alignment lines, flags in decimal and hexadecimal, and their tags."""
    rows = alignments.parse_sam(_sam_lines(spark, d).select("value"))
    tag = lambda t: F.try_element_at("tags", F.lit(t))
    return rows.select(
        "qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", cigar.mismatches(F.map_filter("tags", lambda k, v: k == "NM"), F.lit(None).cast("string")).alias("nm"), tag("HI").alias("hi"),
        cigar.mismatches(F.col("tags"), tag("MD")).alias("by_md"),
    )


@query(f"WITH {SAM} SELECT qname, flag, rname, pos, cigar, hi FROM sam WHERE flag & 4 = 0 AND rname <> 'chr3' AND flag & 2 <> 0 OR flag & 4 = 0 AND rname <> 'chr3' AND flag & 1 = 0")
def usable_reads(spark, d):
    """Mapped reads off an excluded sequence that are single or properly paired."""
    rows = alignments.parse_sam(_sam_lines(spark, d).select("value"))
    return fragments.properly_paired(fragments.mapped(rows, ("chr3",))).select("qname", "flag", "rname", "pos", "cigar", F.try_element_at("tags", F.lit("HI")).alias("hi"))


# --- annotation ---------------------------------------------------------------------------------


@query(f"""WITH {oracles.EXON} SELECT tid, min(s) AS min_start, max(e) AS max_end, count(*) AS n_exons, CAST(sum(e - s + 1) AS BIGINT) AS exonic_length FROM ex GROUP BY tid""")
def transcript_lengths(spark, d):
    rows = _exons(spark, d).select(F.col("tid").alias("transcript_id"), F.lit("g").alias("gene_id"), F.lit("g").alias("gene_name"), "seqname", "strand", "start", "end")
    return annotation.transcript_table(rows).select(F.col("transcript_id").alias("tid"), "min_start", "max_end", F.size("exons").cast("long").alias("n_exons"), "exonic_length")


@query(
    f"""WITH {oracles.EXON}, t AS (SELECT tid, seqname, strand, CASE WHEN strand = '-' THEN -max(e) ELSE min(s) END AS tss, sum(e - s + 1) AS len FROM ex GROUP BY tid, seqname, strand),
o AS (SELECT *, lag(len) OVER w AS pl, lag(tss) OVER w AS pt FROM t WINDOW w AS (PARTITION BY seqname, strand ORDER BY tss, tid)),
r AS (SELECT *, sum(CASE WHEN len > 150 AND pl > 150 AND tss - pt <= 150 THEN 0 ELSE 1 END) OVER (PARTITION BY seqname, strand ORDER BY tss, tid ROWS UNBOUNDED PRECEDING) AS run FROM o)
SELECT tid, CAST(dense_rank() OVER (ORDER BY m) - 1 AS INTEGER) AS tgroup FROM (SELECT tid, min(tid) OVER (PARTITION BY seqname, strand, run) AS m FROM r)"""
)
def tss_tgroups(spark, d):
    """Transcripts whose start sites lie within 150 bases of the one before."""
    rows = _exons(spark, d).groupBy("tid", "seqname", "strand").agg(F.min("start").alias("min_start"), F.max("end").alias("max_end"), F.sum(F.col("end") - F.col("start") + 1).alias("exonic_length"))
    return annotation.with_tss_tgroup(rows).select("tid", "tgroup")


@query(
    f"""WITH c AS ({oracles.SQL["cassette_features"]}), r AS ({oracles.SQL["retained_features"]}), b AS (SELECT 'cassette_exon' AS type, * FROM c UNION ALL SELECT 'retained_intron', * FROM r)
SELECT CAST(row_number() OVER (ORDER BY type, seqname, strand, start, "end", link_start, link_end) - 1 AS INTEGER) AS feature_id, type, seqname, strand, start, "end", n_including, n_excluding FROM b"""
)
def all_features(spark, d):
    rows = annotation.features(_exons(spark, d))
    return rows.select("feature_id", "type", "seqname", "strand", "start", "end", F.size("including").alias("n_including"), F.size("excluding").alias("n_excluding"))


@query(f"""WITH {oracles.EXON}, t AS (SELECT tid, count(*) AS n FROM ex GROUP BY tid) SELECT tid, CAST(n AS INTEGER) AS n, CAST(row_number() OVER (PARTITION BY n ORDER BY tid) - 1 AS INTEGER) AS "index" FROM t""")
def index_in_group(spark, d):
    """Transcripts numbered within those of as many exons."""
    rows = _exons(spark, d).groupBy("tid").agg(F.count(F.lit(1)).cast("int").alias("tgroup"))
    return annotation.within_tgroup(rows).select("tid", F.col("tgroup").alias("n"), "index")


@query(
    f"""WITH {oracles.EXON}, b AS (SELECT tid, s, e, 'exon' AS kind FROM ex UNION ALL SELECT tid, e + 1, ns - 1, 'intron' FROM nx WHERE ns - 1 >= e + 1)
SELECT tid, s AS start, e AS "end", kind, CAST(row_number() OVER (PARTITION BY tid ORDER BY s, e) - 1 AS INTEGER) AS rank FROM b"""
)
def exons_and_introns(spark, d):
    """Exons and introns of every transcript in turn."""
    return intervals.alternating(_exons(spark, d)).select("tid", "start", "end", "kind", "rank")


@query(
    f"""WITH {oracles.EXON}, g AS (SELECT DISTINCT seqname, strand, s, e FROM ex), p AS (SELECT seqname, strand, s AS p FROM g UNION SELECT seqname, strand, e + 1 FROM g),
n AS (SELECT *, lead(p) OVER (PARTITION BY seqname, strand ORDER BY p) - 1 AS q FROM p), c AS (SELECT DISTINCT n.seqname, n.strand, n.p AS s, n.q AS e FROM n JOIN g ON g.seqname = n.seqname AND g.strand = n.strand AND g.s <= n.p AND g.e >= n.p WHERE q IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY s, e) AS i, row_number() OVER (PARTITION BY tid ORDER BY s DESC, e DESC) AS j FROM ex),
h AS (SELECT tid, seqname, strand, s, e, CASE WHEN strand = '-' THEN 3 ELSE 5 END AS prime FROM k WHERE i = 1 UNION ALL SELECT tid, seqname, strand, s, e, CASE WHEN strand = '-' THEN 5 ELSE 3 END FROM k WHERE j = 1)
SELECT h.tid AS gene_id, h.seqname, h.strand, h.s AS start, h.e AS "end", h.prime FROM h JOIN c ON c.seqname = h.seqname AND c.strand = h.strand AND c.s = h.s AND c.e = h.e"""
)
def consensus_end_exons(spark, d):
    """First and last exons that are segments of their strand's consensus as they stand."""
    exons = _exons(spark, d)
    consensus = intervals.segments(exons.select("seqname", "strand", "start", "end").distinct(), ["seqname", "strand"])
    return intervals.consensus_ends(exons.withColumn("gene_id", F.col("tid")), consensus).select("gene_id", "seqname", "strand", "start", "end", "prime")


# --- pairing and compatibility ------------------------------------------------------------------


def _ends(spark, d):
    """Alignments of orders: three in seven lines of either mate, the sixth line a read without a mate."""
    flag = F.when(F.col("l_linenumber") == 6, 0).otherwise(F.when(F.col("l_linestatus") == "F", 65).otherwise(129)) + F.when(F.col("l_returnflag") == "R", 16).otherwise(0)
    pos = F.col("l_partkey")
    return analog.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("qname"), F.concat(F.lit("chr"), (F.col("l_suppkey") % 3).cast("string")).alias("rname"), flag.alias("flag"), pos.alias("pos"), (pos + F.col("l_quantity").cast("long")).alias("end"),
        (F.col("l_linenumber") % 2).alias("alnnum"), F.col("l_linenumber").alias("cigar"),
    )


ENDS = """en AS (SELECT l_orderkey AS qname, 'chr' || CAST(l_suppkey % 3 AS VARCHAR) AS rname, l_linenumber = 6 AS alone, l_linenumber <> 6 AND l_linestatus <> 'F' AS second, l_returnflag = 'R' AS rev,
  l_partkey AS pos, l_partkey + CAST(l_quantity AS BIGINT) AS e, CAST(l_linenumber % 2 AS INTEGER) AS aln, l_linenumber AS line FROM lineitem),
pr AS (SELECT a.qname, a.rname, a.line AS line1, b.line AS line2, a.rev, a.pos AS pos1, b.pos AS pos2, a.e AS e1, b.e AS e2 FROM en a JOIN en b ON a.qname = b.qname AND a.rname = b.rname AND NOT a.second AND b.second AND a.aln = b.aln
  AND a.rev <> b.rev AND (CASE WHEN a.pos <= b.pos THEN NOT a.rev ELSE a.rev END)
  UNION ALL SELECT qname, rname, line, NULL, rev, pos, NULL, e, NULL FROM en WHERE alone)"""


@query(
    f"""WITH {ENDS} SELECT qname, rname, line1, line2, CASE WHEN rev THEN '-' ELSE '+' END AS strand,
  CASE WHEN line2 IS NULL OR greatest(e1, e2) - least(pos1, pos2) + 1 < greatest(e1 - pos1, e2 - pos2) + 1 THEN 0 ELSE greatest(e1, e2) - least(pos1, pos2) + 1 END AS length FROM pr"""
)
def mate_pairs(spark, d):
    """Valid pairs of mates that face each other, and single reads."""
    rows = fragments.mate_pairs(_ends(spark, d))
    strand = fragments.fragment_strand(cigar.has_flag(F.col("mate1.flag"), cigar.REVERSE), F.lit(False))
    return rows.select("qname", "rname", F.col("mate1.cigar").alias("line1"), F.col("mate2.cigar").alias("line2"), strand.alias("strand"), fragments.naive_length().alias("length"))


@query(
    """WITH n AS (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (WHERE l_linestatus = 'F') <= 1 AND count(*) FILTER (WHERE l_linestatus <> 'F') <= 1)
SELECT l.l_orderkey AS qname, l.l_linenumber AS line FROM lineitem l JOIN n ON n.l_orderkey = l.l_orderkey"""
)
def uniquely_mapped(spark, d):
    rows = analog.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("qname"), F.when(F.col("l_linestatus") == "F", 64).otherwise(128).alias("flag"), F.col("l_linenumber").alias("line"))
    return fragments.uniquely_mapped(rows).select("qname", "line")


SEQS = 40_000


@query(
    f"""WITH {oracles.EXON}, t AS (SELECT DISTINCT tid, tid % {SEQS} AS seqname, strand FROM ex),
f AS (SELECT l_orderkey * 8 + l_linenumber AS frag, (l_orderkey + l_linenumber) % {SEQS} AS seqname, l_partkey % 12 * 100 + l_suppkey % 30 AS a, l_quantity >= 25 AS pair, l_linestatus = 'F' AS plus FROM lineitem),
h AS (SELECT DISTINCT f.frag, t.tid, t.strand, f.a, f.pair FROM f JOIN t ON t.seqname = f.seqname WHERE f.plus = (t.strand = '+')),
b AS (SELECT h.*, EXISTS (SELECT 1 FROM ex WHERE ex.tid = h.tid AND a >= s - 2 AND a + 9 <= e + 2) AS one, EXISTS (SELECT 1 FROM ex WHERE ex.tid = h.tid AND a + 100 >= s - 2 AND a + 109 <= e + 2) AS two FROM h)
SELECT DISTINCT frag, tid, CASE WHEN pair THEN (SELECT CAST(sum(greatest(0, least(e, b.a + 109) - greatest(s, b.a) + 1)) AS BIGINT) FROM ex WHERE ex.tid = b.tid) ELSE 0 END AS frag_len
FROM b WHERE one AND (two OR NOT pair) AND (SELECT min(s) FROM ex WHERE ex.tid = b.tid) <= b.a + CASE WHEN pair THEN 109 ELSE 9 END AND (SELECT max(e) FROM ex WHERE ex.tid = b.tid) >= b.a"""
)
def fragment_compatibility(spark, d):
    """Fragments of one read or two against the orders' exon models, on the fragment's strand."""
    exons = _exons(spark, d)
    models = exons.groupBy("tid").agg(F.first("strand").alias("t_strand"), F.min("start").alias("min_start"), F.max("end").alias("max_end"), F.sort_array(F.collect_set(F.struct("start", "end"))).alias("exons"))
    models = models.select("tid", F.lit("g").alias("gene_id"), (F.col("tid") % SEQS).alias("seqname"), "t_strand", "min_start", "max_end", "exons")
    at, pair = F.col("l_partkey") % 12 * 100 + F.col("l_suppkey") % 30, F.col("l_quantity") >= 25
    block = lambda shift: F.array(F.struct((at + shift).alias("start"), (at + shift + 9).alias("end")))
    rows = analog.table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("frag"), ((F.col("l_orderkey") + F.col("l_linenumber")) % SEQS).alias("seqname"), F.when(F.col("l_linestatus") == "F", "+").otherwise("-").alias("strand"),
        at.alias("start"), (at + F.when(pair, 109).otherwise(9)).alias("end"), block(0).alias("blocks1"), F.when(pair, block(100)).alias("blocks2"),
    )
    return fragments.compatibility(rows, models, "forward").select("frag", "tid", "frag_len").distinct()


@query(
    """WITH r AS (SELECT l_suppkey AS rname, l_partkey AS pos, l_orderkey * 8 + l_linenumber AS place, lag(l_partkey) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 8 + l_linenumber, l_partkey) AS before FROM lineitem)
SELECT rname, pos, place FROM r WHERE before > pos"""
)
def unsorted_reads(spark, d):
    """Reads before whose place in the file one of a later position stands."""
    at = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    rows = analog.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("rname"), F.col("l_partkey").alias("pos"), at.alias("place"), F.struct(at, F.col("l_partkey")).alias("order"))
    return fragments.unsorted_rows(rows, "rname", "order").select("rname", "pos", "place")


HEADER = ("chr3", "chr0", "chr4", "chr1", "chr2")


@query(
    f"""WITH {SAM}, h AS (SELECT unnest({list(HEADER)}) AS rname, unnest(range({len(HEADER)})) AS i), k AS (SELECT DISTINCT rname, pos FROM sam)
SELECT k.rname, pos, row_number() OVER (ORDER BY i, pos) AS place FROM k JOIN h ON h.rname = k.rname"""
)
def header_order(spark, d):
    """Places of reads by the order of sequences in a header, then by position: counted within a sequence, sequences added up."""
    rows = alignments.parse_sam(_sam_lines(spark, d).select("value")).select("rname", "pos").distinct()
    ranked = alignments.with_header_rank(rows, HEADER).withColumn("n", F.row_number().over(Window.partitionBy("header_rank").orderBy("pos")))
    before = ranked.groupBy("header_rank").agg(F.count(F.lit(1)).alias("size"))
    before = before.select("header_rank", F.coalesce(F.sum("size").over(Window.orderBy("header_rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return ranked.join(before, "header_rank").select("rname", "pos", (F.col("before") + F.col("n")).alias("place"))


@query(
    """WITH s AS (SELECT l_linenumber AS position, l_returnflag AS sample, 1 + avg(l_discount) AS bias FROM lineitem GROUP BY ALL)
SELECT a.sample AS sample_a, b.sample AS sample_b, round(avg(abs(log2(a.bias) - log2(b.bias))), 9) + 0.0 AS difference FROM s a JOIN s b ON a.position = b.position AND a.sample < b.sample GROUP BY ALL"""
)
def motif_difference(spark, d):
    """Mean absolute log ratio of two samples' bias over positions."""
    rows = analog.table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("position"), F.col("l_returnflag").alias("sample")).agg((1 + F.avg("l_discount")).alias("bias"))
    return _rounded(registry.motif_difference(rows), 9, "sample_a", "sample_b")


# --- weights ------------------------------------------------------------------------------------

PDF = f"""{oracles.HIST}, tot AS (SELECT coalesce(sum(c), 0) AS n FROM h),
nrm AS (SELECT x AS length, exp(-0.5::DOUBLE * ((x - 200) / 100.0::DOUBLE) * ((x - 200) / 100.0::DOUBLE)) AS c FROM range(1, 1001) t(x)),
pdf AS (SELECT length, CAST(c AS DOUBLE) / n AS p FROM h, tot WHERE n >= 10000 UNION ALL SELECT length, c / (SELECT sum(c) FROM nrm) FROM nrm, tot WHERE n < 10000)"""
RATE = 0.002


@query(
    f"""WITH {oracles.EXON}, {PDF}, t AS (SELECT tid, sum(e - s + 1) AS n FROM ex GROUP BY tid), ln AS (SELECT DISTINCT n FROM t),
w AS (SELECT ln.n, sum(p * pow(1 - {RATE}::DOUBLE, length) * (1 - pow(1 - {RATE}::DOUBLE, ln.n - length + 1)) / {RATE}::DOUBLE) AS w FROM ln JOIN pdf ON pdf.length <= ln.n AND p >= 1e-3::DOUBLE GROUP BY ln.n),
u AS (SELECT ln.n, sum(p * (ln.n - length + 1)) AS u FROM ln JOIN pdf ON pdf.length <= ln.n AND p < 1e-3::DOUBLE GROUP BY ln.n)
SELECT CAST(t.tid AS INTEGER) AS tid, round(greatest(25.0::DOUBLE, coalesce(w.w, 0) + coalesce(u.u, 0)), 4) + 0.0 AS weight FROM t LEFT JOIN w ON w.n = t.n LEFT JOIN u ON u.n = t.n"""
)
def transcript_weights(spark, d):
    """Effective lengths of the orders' exon models under their lengths and a 3' bias."""
    lengths = bias.LengthModel.fit(fragments.length_histogram(_lags(spark, d)), most=1000)
    exons = _exons(spark, d).groupBy("tid").agg(F.sum(F.col("end") - F.col("start") + 1).alias("exonic_length"))
    return _rounded(weights.transcript_weights(exons.select(F.col("tid").cast("int").alias("tid"), "exonic_length"), lengths, RATE), 4, "tid")


@query(
    f"""WITH {PDF}, md AS (SELECT min(length) AS m FROM (SELECT length, sum(p) OVER (ORDER BY length) AS upto FROM pdf) WHERE upto >= 0.5::DOUBLE),
f AS (SELECT l_orderkey * 8 + l_linenumber AS frag, CAST(l_partkey AS INTEGER) AS tid, CASE WHEN l_linenumber = 5 THEN md.m ELSE CAST(l_quantity AS BIGINT) * 20 END AS len,
  CASE WHEN l_linestatus = 'F' THEN 0.9::DOUBLE ELSE 1 - 0.9::DOUBLE END * (1 - l_discount) AS f, 25 + l_partkey % 100 AS w FROM lineitem, md),
q AS (SELECT f.*, CASE WHEN p >= 1e-5::DOUBLE THEN p ELSE 0 END AS p FROM f LEFT JOIN pdf ON pdf.length = f.len)
SELECT frag, tid, round(coalesce(p, 0) * f / w, 12) + 0.0 AS w FROM q WHERE coalesce(p, 0) * f >= 1e-6::DOUBLE"""
)
def fragment_weights(spark, d):
    """Probability of each line, taken for a fragment, given its part."""
    lengths = bias.LengthModel.fit(fragments.length_histogram(_lags(spark, d)), most=1000)
    lines = analog.table(spark, d, "lineitem")
    pairs = lines.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("frag"), F.col("l_partkey").cast("int").alias("tid"), F.when(F.col("l_linenumber") == 5, 0).otherwise(F.col("l_quantity").cast("long") * 20).alias("frag_len"),
        (F.col("l_linestatus") == "F").alias("agrees"), (1 - F.col("l_discount")).alias("bias"),
    )
    own = analog.table(spark, d, "part").select(F.col("p_partkey").cast("int").alias("tid"), (25 + F.col("p_partkey") % 100).cast("double").alias("weight"))
    return _rounded(weights.fragment_weights(pairs, own, lengths, 0.9), 12, "frag", "tid")


@query(
    f"""WITH {oracles.WT}, b AS (SELECT read, seq % 3 AS locus, max(align_pr) AS a FROM wt GROUP BY ALL), s AS (SELECT read, locus, CAST(a AS DOUBLE) / CAST(sum(a) OVER (PARTITION BY read) AS DOUBLE) AS share FROM b),
k AS (SELECT * FROM s WHERE share >= 0.1::DOUBLE) SELECT wt.tid, wt.read AS frag, round(max(w * share), 9) + 0.0 AS w FROM wt JOIN k ON k.read = wt.read AND k.locus = wt.seq % 3 GROUP BY wt.tid, wt.read"""
)
def weight_matrix(spark, d):
    """Best alignment of each order on each brand, improbable loci dropped."""
    rows = _weights(spark, d).select(F.col("read").alias("frag"), "tid", (F.col("seq") % 3).alias("locus"), "align_pr", "w")
    return _rounded(weights.weight_matrix(rows), 9, "tid", "frag")


@query(
    """WITH g AS (SELECT l_returnflag AS sample, l_partkey AS tid, avg(l_discount) * avg(l_quantity) AS v FROM lineitem GROUP BY l_returnflag, l_partkey), m AS (SELECT sample, tid, v / (25 + tid % 100) AS v FROM g)
SELECT sample, tid, round(v / sum(v) OVER (PARTITION BY sample) * 1e6, 6) + 0.0 AS value FROM m"""
)
def normalised_expression(spark, d):
    """Mixtures over weights, as shares of a sample."""
    rows = analog.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("sample"), F.col("l_partkey").alias("tid")).agg(F.avg("l_discount").alias("tmix"), F.avg("l_quantity").alias("cmix"))
    out = weights.expression(rows.withColumn("weight", (25 + F.col("tid") % 100).cast("double")))
    return _rounded(out.withColumn("value", F.col("value") * 1e6), 6, "sample", "tid")


@query(
    """WITH w AS (SELECT DISTINCT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS sample, CAST(l_orderkey AS INTEGER) AS tid FROM lineitem),
m AS (SELECT sample, tid, min(tid) OVER (PARTITION BY sample, tid // 40) AS least FROM w)
SELECT sample, tid, CAST(dense_rank() OVER (PARTITION BY sample ORDER BY least) - 1 AS INTEGER) AS component FROM m"""
)
def fragment_components(spark, d):
    """Orders tied by their own lines and by groups of forty orders, numbered within samples."""
    lines = analog.table(spark, d, "lineitem")
    rows = lines.select(F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("sample"), F.col("l_orderkey").cast("int").alias("tid"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("frag"))
    groups = lines.select(F.col("l_orderkey").cast("int").alias("tid")).distinct().withColumn("tgroup", F.floor(F.col("tid") / 40).cast("int"))
    return components.fragment_components(rows, groups)


# --- summaries ----------------------------------------------------------------------------------


@query(oracles.SQL["transcript_expression"])
def scaled_expression(spark, d):
    """Draws joined with their scales, which are divided out."""
    quant = analog.quant(spark, d)
    out = summaries.transcript_expression(quant, scaling.quantile_scale(quant), analog.transcripts(spark, d), LEVEL)
    return _rounded(out, 4, "sample", "tid", "gene_id", "transcript_id")


@query(oracles.SQL["experiment_splicing"])
def experiment_splicing_sigma(spark, d):
    out = summaries.experiment_splicing_sigma(analog.experiment_splice_mu(spark, d).drop("tgroup"), analog.transcripts(spark, d), LEVEL)
    return _rounded(out, 6, "tid", "tgroup", "transcript_id")


@query("""SELECT l_returnflag AS condition_name, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS files FROM lineitem GROUP BY l_returnflag""")
def files_by_condition(spark, d):
    rows = analog.samples(spark, d).withColumn("filename", F.col("l_linestatus"))
    return summaries.files_by_condition(rows).select("condition_name", F.array_join("files", ",").alias("files"))


# --- sequences, CIGAR, densities ----------------------------------------------------------------


@query(
    """WITH c AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS s, CAST(l_quantity AS INTEGER) AS m, CAST(l_suppkey % 50 + 1 AS INTEGER) AS n, CAST(l_partkey % 30 + 1 AS INTEGER) AS m2 FROM lineitem)
SELECT k AS l_orderkey, concat(s, 'S', m, 'M', n, 'N', m2, 'M', s, 'I') AS cigar, k - s AS s_start, k - 1 AS s_end, k AS m_start, k + m - 1 AS m_end, k + m AS n_start, k + m + n - 1 AS n_end, k + m + n + m2 AS i_start, s AS left_clip, 0 AS right_clip,
  concat('[', k, ',', k + m - 1, '][', k + m + n, ',', k + m + n + m2 - 1, ']') AS blocks FROM c"""
)
def cigar_places(spark, d):
    """Where each operation starts and ends, clipped ends, and the aligned blocks."""
    n = lambda c: F.col(c).cast("int").cast("string")
    text = F.concat(n("l_linenumber"), F.lit("S"), n("l_quantity"), F.lit("M"), (F.col("l_suppkey") % 50 + 1).cast("string"), F.lit("N"), (F.col("l_partkey") % 30 + 1).cast("string"), F.lit("M"), n("l_linenumber"), F.lit("I"))
    rows = analog.table(spark, d, "lineitem").select("l_orderkey", text.alias("cigar")).distinct()
    ops = cigar.operations(F.col("cigar"))
    places = cigar.placed(F.col("l_orderkey"), ops)
    rows = rows.select("l_orderkey", "cigar", places.alias("p"), *[c.alias(name) for c, name in zip(cigar.soft_clips(ops), ("left_clip", "right_clip"), strict=True)], cigar.aligned_blocks(F.col("l_orderkey"), ops).alias("b"))
    at = lambda i, what, name: F.get("p", F.lit(i))[what].alias(name)
    return rows.select(
        "l_orderkey", "cigar", at(0, "start", "s_start"), at(0, "end", "s_end"), at(1, "start", "m_start"), at(1, "end", "m_end"), at(2, "start", "n_start"), at(2, "end", "n_end"), at(4, "start", "i_start"), "left_clip", "right_clip",
        F.array_join(F.transform("b", lambda x: F.concat(F.lit("["), x["start"].cast("string"), F.lit(","), x["end"].cast("string"), F.lit("]"))), "").alias("blocks"),
    )


@query("""SELECT l_orderkey, l_linenumber, round(1 / (1 + exp((ln(0.95::DOUBLE) + k * ln(0.01::DOUBLE) + (n - k) * ln(0.99::DOUBLE)) - (ln(0.05::DOUBLE) + k * ln(0.05::DOUBLE) + (n - k) * ln(0.95::DOUBLE)))), 12) + 0.0 AS wrong
FROM (SELECT l_orderkey, l_linenumber, l_suppkey % 12 AS k, CAST(l_quantity AS INTEGER) + 20 AS n FROM lineitem)""")
def misaligned(spark, d):
    rows = analog.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", cigar.misaligned_probability(F.col("l_suppkey") % 12, F.col("l_quantity").cast("int") + 20).alias("wrong"))
    return _rounded(rows, 12, "l_orderkey", "l_linenumber")


BASE = "list_position(['a', 'c', 'g', 't'], {0}) - 1"


@query(
    f"""WITH {oracles.SQ}, x AS (SELECT doc_id, s FROM sq WHERE length(s) >= 8)
SELECT doc_id, CAST(64 * ({BASE.format("s[1]")}) + 16 * ({BASE.format("s[3]")}) + 4 * ({BASE.format("s[4]")}) + {BASE.format("s[8]")} AS BIGINT) AS masked, CAST({BASE.format("s[2]")} AS INTEGER) AS code, s[1:4] AS back,
  repeat('N', 3) || s[1:4] AS left_padded, rpad(s[length(s) - 2:length(s)], 7, 'N') AS right_padded, s[1:3] || s[5:6] || rpad(s[7:8], 2, 'N') AS joined FROM x"""
)
def sequence_pieces(spark, d):
    """Codes, masked k-mers, padded windows and spliced pieces of the letters a, c, g and t of each text."""
    s = F.col("s")
    rows = analog.table(spark, d, "documents").select("doc_id", F.regexp_replace(F.lower("text"), "[^acgt]", "").alias("s")).where("length(s) >= 8")
    mask = F.array(*[F.lit(i in (0, 2, 3, 7)) for i in range(8)])
    exon = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    return rows.select(
        "doc_id", seq.masked_kmer_number(F.substring(s, 1, 8), mask).alias("masked"), seq.nucleotide_code(F.substring(s, 2, 1)).alias("code"), seq.kmer_string(seq.kmer_number(F.substring(s, 1, 4)), 4).alias("back"),
        seq.padded_substring(s, F.lit(-3), F.lit(7)).alias("left_padded"), seq.padded_substring(s, F.length(s) - 3, F.lit(7)).alias("right_padded"), seq.spliced(s, F.array(exon(0, 2), exon(4, 5)), 0, 2).alias("joined"),
    )


LN = "lgamma"


@query(
    f"""WITH x AS (SELECT p_partkey, p_retailprice / 1000 AS x, CAST(p_size AS DOUBLE) AS k, 1 + p_partkey % 7 AS a, 0.5::DOUBLE + p_partkey % 5 AS b FROM part)
SELECT p_partkey, round(a * ln(b) - lgamma(a) + (a - 1) * ln(x) - b * x, 6) + 0.0 AS gamma_rate, round(a * ln(a / b) - lgamma(a) + (a - 1) * ln(x) - a / b * x, 6) + 0.0 AS gamma_mean, round(k * ln(b) - b - lgamma(k + 1), 6) + 0.0 AS poisson,
  round(-0.5 * ln(2 * pi()) - ln(b) - 0.5 * ((x - a) / b) * ((x - a) / b), 6) + 0.0 AS normal, round(-0.5 * ln(2 * pi()) - ln(b) - 0.5 * ((ln(x) - a) / b) * ((ln(x) - a) / b) - ln(x), 6) + 0.0 AS log_normal,
  round(lgamma((a + 1) / 2.0) - lgamma(a / 2.0) - 0.5 * ln(a * pi()) - ln(b) - (a + 1) / 2.0 * ln(1 + (x - 1) / b * (x - 1) / b / a), 6) + 0.0 AS student, round(a * ln(b) - lgamma(a) - (a + 1) * ln(x) - b / x, 6) + 0.0 AS inverse_gamma,
  round(a * ln(b) - lgamma(a) - (a + 1) * ln(x * x) - b / (x * x) + ln(2 * x), 6) + 0.0 AS squared_inverse_gamma,
  round(lgamma(a + b) - lgamma(a) - lgamma(b) + (a - 1) * ln(x / 10) + (b - 1) * ln(1 - x / 10), 6) + 0.0 AS beta, round((a - 1) / x - b, 6) + 0.0 AS gamma_dx, round((a - x) / (b * b), 6) + 0.0 AS normal_dx FROM x"""
)
def log_densities(spark, d):
    rows = analog.table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") / 1000).alias("x"), F.col("p_size").cast("double").alias("k"), (1 + F.col("p_partkey") % 7).cast("double").alias("a"), (F.lit(0.5) + F.col("p_partkey") % 5).alias("b"))
    kinds = "gamma_rate, gamma_mean, poisson, normal, log_normal, student, inverse_gamma, squared_inverse_gamma, beta, gamma_dx, normal_dx".split(", ")

    def run(batches):
        D = densities
        for t in batches:
            x, k, a, b = (t[c].to_numpy() for c in "xkab")
            values = (D.gamma_rate(x, a, b), D.gamma_mean(x, b, a), D.poisson(k, b), D.normal(x, a, b), D.log_normal(x, a, b), D.student_t(x, a, 1.0, b), D.inverse_gamma(x, a, b), D.squared_inverse_gamma(x, a, b), D.beta(x / 10, a, b), D.gamma_rate_dx(x, a, b), D.normal_dx(x, a, b))
            yield t[["p_partkey"]].assign(**dict(zip(kinds, values, strict=True)))

    return _rounded(rows.mapInPandas(run, "p_partkey long, " + ", ".join(f"{k} double" for k in kinds)), 6, "p_partkey")

