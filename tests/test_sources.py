"""Readers and writers on small files."""

import gzip
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from posterra.sources import alignments, annotation, bam, design, store

GTF = """#comment
chr1\tsrc\tgene\t101\t600\t.\t+\t.\tgene_id "G1";
chr1\tsrc\texon\t101\t200\t.\t+\t.\tgene_id "G1"; transcript_id "T1"; gene_name "g"; gene_biotype "b";

chr1\tsrc\texon\t301\t400\t1.5\t+\t0\tgene_id "G1"; transcript_id "T1"; gene_name "g";
chr1\tsrc\texon\t301\t400\t1.5\t+\t0\tgene_id "G1"; transcript_id "T1"; gene_name "g";
chr1\tsrc\tCDS\t310\t390\t.\t+\t0\tgene_id "G1"; transcript_id "T1";
chr1\tsrc\texon\t1\t50\t.\t-\t.\tgene_id "G2";
"""


def test_gtf(spark, tmp_path):
    (tmp_path / "a.gtf").write_text(GTF)
    gtf = annotation.read_gtf(spark, str(tmp_path / "a.gtf"))
    assert gtf.count() == 6
    row = gtf.where("score = 1.5").first()
    assert (row.start, row.end, row.strand, row.frame, row.attributes["transcript_id"]) == (301, 400, "+", 0, "T1")
    exons = annotation.exons(gtf)
    assert sorted((r.transcript_id, r.gene_name, r.start, r.end) for r in exons.collect()) == [("T1", "g", 100, 199), ("T1", "g", 300, 399)]
    (tmp_path / "b.gtf").write_text("chr1\tonly three\tfields\n")
    with pytest.raises(Exception, match="malformed"):
        annotation.read_gtf(spark, str(tmp_path / "b.gtf")).collect()


def test_intron_pairs(spark, tmp_path):
    (tmp_path / "i.bed").write_text("chr1\t1000\t1100\tx\t0\t+\nchr1\t1200\t1300\tx\t0\t+\n")
    got = sorted((r.transcript_id, r.start, r.end) for r in annotation.read_introns(spark, str(tmp_path / "i.bed")).collect())
    assert got == [("x-excluded", 800, 999), ("x-excluded", 1300, 1499), ("x-included", 800, 999), ("x-included", 1100, 1199), ("x-included", 1300, 1499)]
    (tmp_path / "j.bed").write_text("chr1\t1000\t1100\tx\t0\t+\n")
    with pytest.raises(Exception, match="pairs"):
        annotation.read_introns(spark, str(tmp_path / "j.bed")).collect()
    with pytest.raises(NotImplementedError):
        annotation.read_exon_list(spark, "x")


def test_fasta_and_side_files(spark, tmp_path):
    (tmp_path / "f.fa").write_text(">chr1 first\nACGT\nacgt\n>chr2\nTT\n")
    assert sorted(tuple(r) for r in annotation.read_fasta(spark, str(tmp_path / "f.fa")).collect()) == [("chr1", "ACGTACGT"), ("chr2", "TT")]
    (tmp_path / "g.txt").write_text("T1,T2\n\nT3\n")
    assert sorted(tuple(r) for r in annotation.read_groups(spark, str(tmp_path / "g.txt")).collect()) == [(0, 0, "T1"), (0, 1, "T2"), (1, 0, "T3")]
    (tmp_path / "n.txt").write_text("chr1\nchr1\n chr2\n")
    assert annotation.read_names(spark, str(tmp_path / "n.txt")).count() == 2


SAM = "@HD\tVN:1.0\nr1\t99\tchr1\t101\t60\t5M\t=\t201\t105\tACGTA\tIIIII\tNM:i:1\tMD:Z:3A1\nr2\tpR1\t*\t0\t0\t*\t*\t0\t0\t*\t*\n"


def test_sam(spark, tmp_path):
    (tmp_path / "a.sam").write_text(SAM)
    r = {x.qname: x for x in alignments.read_alignments(spark, str(tmp_path / "a.sam")).collect()}
    assert (r["r1"].pos, r["r1"].rnext, r["r1"].pnext, r["r1"].tags) == (100, "chr1", 200, {"NM": "1", "MD": "3A1"})
    assert r["r2"].flag == 1 + 32 + 64 and r["r2"].pos == -1
    (tmp_path / "b.sam").write_text("r1\t0\tchr1\t1\t60\t5M\t*\t0\t0\tACG\tIII\n")
    with pytest.raises(Exception, match="disagree"):
        alignments.read_sam(spark, str(tmp_path / "b.sam")).select("qname").collect()
    assert alignments.is_sam(b"@SQ\tSN:x") and not alignments.is_sam(b"a: [x.bam]\n")


def bam_bytes(names, records):
    """Contents of a BAM file: records as (qname, flag, ref, pos, mapq, [(len, op)], seq)."""
    body = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", len(names))
    for name, length in names:
        body += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    for qname, flag, ref, pos, mapq, cigar, seq in records:
        packed = bytes((bam._SEQ.index(seq[i]) << 4) | (bam._SEQ.index(seq[i + 1]) if i + 1 < len(seq) else 0) for i in range(0, len(seq), 2))
        data = struct.pack("<iiBBHHHiiii", ref, pos, len(qname) + 1, mapq, 0, len(cigar), flag, len(seq), -1, -1, 0) + qname.encode() + b"\0"
        data += b"".join(struct.pack("<I", n << 4 | bam._OPS.index(op)) for n, op in cigar) + packed + b"\x1e" * len(seq) + b"NMC\0"
        body += struct.pack("<i", len(data)) + data
    return body


def bgzf_block(data):
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return bam.BLOCK_HEAD + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def bgzf(data, sizes):
    """``data`` in blocks whose sizes come from an iterator, and the empty block at the end."""
    out, at = [], 0
    while at < len(data):
        n = next(sizes)
        out.append(bgzf_block(data[at : at + n]))
        at += n
    return b"".join(out) + bgzf_block(b"")


def reads(n, seed=1, longest=400):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        size = rng.choice([0, 5, rng.randint(1, longest)])
        out.append((f"read{i}/{rng.random()}", rng.randint(0, 4095), rng.randint(-1, 1), rng.randint(-1, 10**8), 7, [(size, "M")] if size else [], "".join(rng.choice("ACGTN") for _ in range(size))))
    return out


def test_bam_of_plain_gzip(spark, tmp_path):
    path = str(tmp_path / "a.bam")
    content = bam_bytes([("chr1", 1000), ("chr2", 500)], [("q1", 0, 1, 10, 7, [(3, "M"), (20, "N"), (2, "M")], "ACGTN"), ("q2", 4, -1, -1, 0, [], "AC")])
    for data in (gzip.compress(content), bgzf(content, iter([10**6])), gzip.compress(content[:40]) + gzip.compress(content[40:])):
        (tmp_path / "a.bam").write_bytes(data)
        got = {r.qname: r for r in alignments.read_alignments(spark, path).collect()}
        assert set(got) == {"q1", "q2"}
        assert (got["q1"].rname, got["q1"].pos, got["q1"].cigar, got["q1"].seq, got["q1"].qual, got["q1"].tags) == ("chr2", 10, "3M20N2M", "ACGTN", "?????", {"NM": "0"})
        assert (got["q2"].rname, got["q2"].cigar) == ("*", "*")


@pytest.mark.parametrize("largest", [300, 5000, 65280])
def test_bam_in_ranges(spark, tmp_path, largest):
    """One file as few and as many ranges gives equal rows, whatever the block borders cut."""
    rng = random.Random(largest)
    own = reads(3000)
    (tmp_path / "x y%").mkdir()
    names = [(f"chr{i}", 10**8) for i in range(2)]
    data = bgzf(bam_bytes(names, own), iter(lambda: rng.randint(1, largest), None))
    (tmp_path / "x y%" / "a.bam").write_bytes(data)
    (tmp_path / "x y%" / "b.bam").write_bytes(bgzf(bam_bytes([("other", 5), *names], [("b", 0, 0, 1, 2, [], "A")]), iter([50] * 100)))
    want = sorted([(r[0], r[1], f"chr{r[2]}" if r[2] >= 0 else "*", r[3], r[6] or "*") for r in own] + [("b", 0, "other", 1, "A")])
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for ranges in (1, 4, 50):
            for k in before:
                spark.conf.set(k, str(-(-len(data) // ranges) + 1))
            rows = bam.read_bam(spark, str(tmp_path / "x y%"))
            assert sorted((r.qname, r.flag, r.rname, r.pos, r.seq) for r in rows.collect()) == want
            for k in before:
                spark.conf.set(k, str(max(64, len(data) // ranges)))
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            assert bam.read_bam(spark, str(tmp_path / "x y%")).count() == len(want)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_range_parts_at_every_border():
    """Cut anywhere, the ends of ranges meet in whole records; a range without a start gives all to its neighbours."""
    own = reads(60, 3, 60)
    content = bam_bytes([("chr1", 9), ("chr2", 9)], own)
    opens = bam.parse_header(content)[1]
    for cut in range(opens + 1, len(content), 7):
        left = list(bam.parts(iter([content[:cut]]), 2, True))
        right = list(bam.parts(iter([content[cut:][i : i + 50] for i in range(0, len(content) - cut, 50)]), 2, False))
        assert left[0] == (bam.HEAD, b"") and left[-1][0] == bam.TAIL
        records = b"".join(d for k, d in left if k == bam.RECORDS) + left[-1][1] + b"".join(d for k, d in right if k != bam.TAIL)
        assert bam.whole(records) == len(records) and records + right[-1][1] * (right[-1][0] == bam.TAIL) == content[opens:]
        if right[0][0] == bam.HEAD:
            joined = left[-1][1] + right[0][1]
            assert bam.whole(joined) == len(joined)


def test_bam_faults(spark, tmp_path):
    content = bam_bytes([("chr1", 9), ("chr2", 9)], reads(50, 5))
    (tmp_path / "cut.bam").write_bytes(bgzf(content[:-5], iter([1000] * 1000)))
    with pytest.raises(Exception, match="cut off"):
        bam.read_bam(spark, str(tmp_path / "cut.bam")).count()
    whole = bytearray(bgzf(content, iter([3000] * 1000)))
    whole[-40] ^= 1
    (tmp_path / "sum.bam").write_bytes(bytes(whole))
    with pytest.raises(Exception, match="checksum|invalid|Error"):
        bam.read_bam(spark, str(tmp_path / "sum.bam")).count()
    (tmp_path / "head.bam").write_bytes(bgzf(content[:20], iter([1000])))
    with pytest.raises(ValueError, match="header"):
        bam.read_bam(spark, str(tmp_path / "head.bam"))
    names = [(f"sequence{i:06}", 1) for i in range(40_000)]
    (tmp_path / "long.bam").write_bytes(bgzf(bam_bytes(names, [("q", 0, 39_999, 1, 0, [], "A")] * 20), iter([60000] * 1000)))
    assert {r.rname for r in bam.read_bam(spark, str(tmp_path / "long.bam")).collect()} == {"sequence039999"}


def test_block_contents():
    data = bgzf_block(b"abc")
    assert bam.block(data[len(bam.BLOCK_HEAD) :]) == b"abc" and bam.inflate(data + bgzf_block(b"defg")) == b"abcdefg"
    with pytest.raises(ValueError, match="states"):
        bam.block(data[len(bam.BLOCK_HEAD) :] + b"x")


def test_design(spark):
    rows = design.from_yaml(spark, "ctl:\n  a: 1.bam\n  b: 2.bam\ntrt: [3.bam, 4.bam]\n").orderBy("sample").collect()
    assert [(r.sample, r.condition, r.condition_name, r.sample_name, r.filename) for r in rows] == [(0, 0, "ctl", "a", "1.bam"), (1, 0, "ctl", "b", "2.bam"), (2, 1, "trt", "trt-1", "3.bam"), (3, 1, "trt", "trt-2", "4.bam")]
    assert [r.sample_name for r in design.from_arguments(spark, ["a,b", "c"]).orderBy("sample").collect()] == ["condition-1-1", "condition-1-2", "condition-2-1"]
    with pytest.raises(ValueError):
        design.from_yaml(spark, "ctl: 5\n")


def test_store_and_text(spark, tmp_path):
    path = str(tmp_path / "s")
    for draw in range(2):
        store.write(spark.createDataFrame([(draw, k, 0, 0.25 * (k + 1)) for k in range(2)], "draw int, sample int, tid int, value double"), path, "quant")
    got = store.read(spark, path, "quant")
    assert got.count() == 4 and "PartitionFilters: [isnotnull(sample" in got.where("sample = 1")._jdf.queryExecution().toString()
    wide = store.wide(got, ["draw"], "sample", {0: "a", 1: "b"}, {"value": "_tpm"})
    assert [tuple(r) for r in wide.orderBy("draw").collect()] == [(0, 0.25, 0.5), (1, 0.25, 0.5)]
    store.write_tsv(spark.createDataFrame([(1, 0.5, 0.1234567)], "tid int, estimate double, up_pr double"), str(tmp_path / "t"))
    text = next((tmp_path / "t").glob("*.csv")).read_text().splitlines()
    assert text == ["tid\testimate\tup_pr", "1\t5.000000e-01\t0.123"]


def test_deflated_samples(spark):
    df = spark.createDataFrame([(bytearray(zlib.compress(struct.pack("<2f", 1.5, 2.0))),)], "b binary")
    assert df.select(store.inflated_floats(F.col("b")).alias("v")).first().v == [1.5, 2.0]


def test_exons_are_parsed_once(spark):
    """Lines are read and looked up in one pass; of rows at one place the least names count."""
    line = lambda feature, start, end, gene: f'c\ts\t{feature}\t{start}\t{end}\t.\t+\t.\tgene_id "{gene}"; transcript_id "T";'
    df = spark.createDataFrame([(line(*x),) for x in (("exon", 11, 20, "G2"), ("exon", 11, 20, "G1"), ("CDS", 11, 20, "G3"), ("exon", 31, 40, "G0"), ("gene", 1, 99, "G"))], "value string")
    got = annotation.exons(annotation.parse_gtf(df))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2
    assert sorted((r.gene_id, r.start, r.end, r.gene_name) for r in got.collect()) == [("G3", 10, 19, ""), ("G3", 30, 39, "")]
