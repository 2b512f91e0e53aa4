"""Running sums, FASTA index and tiles, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from posterra.operators import prefix
from posterra.sources import fasta


@pytest.mark.parametrize("keyed", [False, True])
def test_running_sums(spark, keyed):
    """Hot keys over many partitions, nulls in keys, order and values."""
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", None, "a", "b"]), None if i % 97 == 0 else i, None if i % 31 == 0 else rng.randint(-5, 9)) for i in rng.sample(range(3000), 3000)]
    df = spark.createDataFrame(rows, "k string, at long, v long")
    got = prefix.running(df, ["at", "v"], {"sum": F.col("v"), "n": F.lit(1)}, ["k"] if keyed else [])
    found = sorted((tuple(r) for r in got.collect()), key=lambda r: (r[0] is not None, r[0] or "", r[4]) if keyed else r[4])
    order = lambda r: (*([r[0] is not None, r[0] or ""] if keyed else []), r[1] is not None, r[1] or 0, r[2] is not None, r[2] or 0)
    total, n, last = 0, 0, object()
    for have, want in zip(found, sorted(rows, key=order), strict=True):
        if keyed and want[0] != last:
            total, n, last = 0, 0, want[0]
        total, n = total + (want[2] or 0), n + 1
        assert have[3:] == (total, n) and (have[0] == want[0] or not keyed)
    assert prefix.running(df.limit(0), ["at"], {"n": F.lit(1)}).count() == 0


def test_ranks_and_caps(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5003).alias("x"))
    assert all(r.place == p for p, r in enumerate(sorted(prefix.ranked(df, ["x"], "place").collect())))
    want, total = [], 0
    for x in sorted(i * 7919 % 5003 for i in range(5000)):
        if total >= 10_000:
            break
        want.append(x)
        total += x + 1
    assert sorted(r.x for r in prefix.until(df, ["x"], F.col("x") + 1, 10_000).collect()) == want
    assert "PythonMapInArrow" not in prefix.ranked(df, ["x"], "place")._jdf.queryExecution().toString()  # the plan is cut


def write_fasta(path, sequences, width, ending="\n"):
    with open(path, "w", newline="") as f:
        for name, seq in sequences:
            f.write(f">{name} of a test{ending}")
            for i in range(0, len(seq), width):
                f.write(seq[i : i + width] + ending)


@pytest.mark.parametrize(("width", "ending"), [(60, "\n"), (50, "\r\n"), (1 << 30, "\n")])
def test_fasta_file(spark, tmp_path, width, ending):
    """Index, tiles and ranges of a file that is read in many ranges, in lines of 60 and in one line a sequence."""
    rng = random.Random(width)
    sequences = [(f"chr{i}", "".join(rng.choice("ACGTNacgtn") for _ in range(n))) for i, n in enumerate((200_000, 1, 0, 65_536, 70_001))]
    path = str(tmp_path / "g.fa")
    write_fasta(path, sequences, width, ending)
    raw = open(path, "rb").read()
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        lines = fasta.read_lines(spark, path)
        index = {r.seqname: r for r in fasta.index(lines).collect()}
        tiles = fasta.read_tiles(spark, path, 10_000, 500).cache()
        got = {(r.seqname, r.tile): (r["first"], r.seq) for r in tiles.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    whole = dict(sequences)
    for name, seq in sequences:
        x = index[name]
        assert x.length == len(seq) and x.line_bases == min(width, len(seq)) and x.line_bytes == (x.line_bases + len(ending) if seq else 0)
        if seq:
            # the index finds every base
            for i in (0, len(seq) // 2, len(seq) - 1):
                assert raw[x.offset + i // x.line_bases * x.line_bytes + i % x.line_bases] == ord(seq[i])
    want = {(n, t): (max(0, t * 10_000 - 500), s[max(0, t * 10_000 - 500) : t * 10_000 + 10_500].upper()) for n, s in sequences for t in range(-(-len(s) // 10_000))}
    assert got == want
    frame = spark.createDataFrame(sequences, "seqname string, seq string")
    assert {(r.seqname, r.tile): (r["first"], r.seq) for r in fasta.tiles_of(frame, 10_000, 500).collect()} == want
    ranges = [(i, f"chr{rng.randint(0, 5)}", a := rng.randint(-30, 200_100), a + rng.choice([-1, 0, 15, 9_999, 30_000])) for i in range(60)]
    found = fasta.fetch(spark.createDataFrame(ranges, "id int, seqname string, start long, end long"), tiles, 10_000)
    base = lambda n, i: whole.get(n, "")[i].upper() if 0 <= i < len(whole.get(n, "")) else "N"
    assert {r.id: r.seq for r in found.collect()} == {i: "".join(base(n, x) for x in range(a, b + 1)) for i, n, a, b in ranges}


@pytest.mark.parametrize("few", [0, 100_000])
def test_wanted_tiles(spark, tmp_path, few):
    """The tiles that ranges touch are made whole, and no others; ranges that share a page are cut from it, and no piece of them is shuffled."""
    rng = random.Random(few)
    sequences = [(f"chr{i}", "".join(rng.choice("ACGT") for _ in range(n))) for i, n in enumerate((200_000, 3, 70_001))]
    write_fasta(str(tmp_path / "g.fa"), sequences, 60)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    data = [(i, "chr0", a := rng.randrange(95_000, 99_000), a + rng.randrange(2_000)) for i in range(50)] + [(50, "chr2", 69_990, 70_100), (51, "chr1", -2, 4), (52, None, 1, 2), (53, "chr0", None, 5)]
    ranges = spark.createDataFrame(data, "id int, seqname string, start long, end long")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        lines = fasta.read_lines(spark, str(tmp_path / "g.fa"))
        tiles = fasta.tiles(lines, 10_000, 500, wanted=fasta.touched(ranges, 10_000), few=few).cache()
        made = {(r.seqname, r.tile): (r["first"], r.seq) for r in tiles.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    whole = dict(sequences)
    want = {(n, t) for n, t in (("chr0", 9), ("chr0", 10), ("chr1", 0), ("chr2", 6), ("chr2", 7))}
    assert made == {(n, t): (max(0, t * 10_000 - 500), whole[n][max(0, t * 10_000 - 500) : t * 10_000 + 10_500]) for n, t in want}
    found = fasta.fetch(ranges, tiles, 10_000)
    base = lambda n, i: whole[n][i] if n and 0 <= i < len(whole[n]) else "N"
    assert {r.id: r.seq for r in found.collect()} == {i: "" if a is None else "".join(base(n, x) for x in range(a, b + 1)) for i, n, a, b in data}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "rpad" in plan[: plan.index("Exchange")] and "substring(__page" in plan[: plan.index("Exchange")]


def test_uneven_lines_and_index_file(spark, tmp_path):
    for body in ("ACGT\nAC\nACGT\n", "ACGT\nACGTA\n"):
        (tmp_path / "u.fa").write_text(">x\n" + body)
        with pytest.raises(Exception, match="different length"):
            fasta.index(fasta.read_lines(spark, str(tmp_path / "u.fa"))).collect()
    (tmp_path / "g.fa.fai").write_text("chr1\t100\t6\t60\t61\n")
    assert [tuple(r) for r in fasta.read_index(spark, str(tmp_path / "g.fa.fai")).collect()] == [("chr1", 100, 6, 60, 61)]
