"""Densities, slice sampling, bias models, counting and a small analysis from files to summaries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from posterra.model import analyze, bias, gibbs, weights
from posterra.model import densities as D
from posterra.model.slice import Counter, maximum, sample
from posterra.operators import annotation as annotate
from posterra.plans import registry
from posterra.sources import alignments, annotation, design


@pytest.mark.parametrize(
    ("f", "df", "x"),
    [
        (lambda x: D.gamma_mean(x, 2.0, 3.0), lambda x: D.gamma_mean_dx(x, 2.0, 3.0), 1.3),
        (lambda m: D.gamma_mean(1.3, m, 3.0), lambda m: D.gamma_mean_dmean(1.3, m, 3.0), 2.2),
        (lambda s: D.gamma_mean(1.3, 2.0, s), lambda s: D.gamma_mean_dshape(1.3, 2.0, s), 2.7),
        (lambda x: D.normal(x, 0.4, 1.7), lambda x: D.normal_dx(x, 0.4, 1.7), -0.6),
        (lambda s: D.normal(0.1, 0.4, s), lambda s: D.normal_dsigma(0.1, 0.4, s), 1.4),
        (lambda x: D.student_t(x, 5.0, 0.3, 1.2), lambda x: D.student_t_dx(x, 5.0, 0.3, 1.2), 1.1),
        (lambda r: D.poisson(4.0, r), lambda r: D.poisson_drate(4.0, r), 3.0),
    ],
)
def test_derivatives(f, df, x):
    assert df(x) == pytest.approx((f(x + 1e-6) - f(x - 1e-6)) / 2e-6, rel=1e-5)


def test_densities_integrate_to_one():
    x = np.linspace(1e-6, 60, 600_000)
    for f in (lambda v: D.gamma_rate(v, 2.5, 0.7), lambda v: D.log_normal(v, 0.2, 0.6), lambda v: D.squared_inverse_gamma(v, 3.0, 2.0)):
        assert np.trapezoid(np.exp(f(x)), x) == pytest.approx(1, abs=1e-3)
    assert D.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649, abs=1e-9)


def test_slice_sampler_moments():
    n = 4000
    x = np.full(n, 1.0)
    for r in range(30):
        x = sample(lambda v: D.gamma_rate(v, 3.0, 2.0), x, 1e-9, 50.0, Counter(1, r, np.arange(n)), width=1.0)
    assert x.mean() == pytest.approx(1.5, abs=0.05) and x.var() == pytest.approx(0.75, abs=0.08)
    assert maximum(lambda v: D.normal(v, 0.3, 1.0), 2, -1.0, 1.0) == pytest.approx(0.3, abs=1e-6)


def test_draws_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(2)
    values = spark.createDataFrame([(t, c, 2 * c + k, float(rng.gamma(3) / 300)) for t in range(20) for c in range(2) for k in range(2)], "tid int, condition int, sample int, value double")
    state = spark.createDataFrame([(t, c, 0.01, 1.0, 0.01) for t in range(20) for c in range(2)], "tid int, condition int, mean double, shape double, experiment_mean double")
    out = [sorted(tuple(r) for r in gibbs.sample_means(values.repartition(n), state.repartition(n), 5, 3, 1.0, gibbs.Priors()).collect()) for n in (1, 2, 8)]
    assert out[0] == out[1] == out[2] and len(out[0]) == 40


def test_component_recovers_mixture():
    rng = np.random.default_rng(3)
    w = np.full((2, 300), 0.1)
    own = rng.random(300) < 0.8
    w[0, own], w[1, own], w[0, ~own], w[1, ~own] = 1.0, 1e-6, 1e-6, 1.0
    tmix, cmix, seen = np.array([0.5, 0.5]), 300.0, []
    for r in range(60):
        tmix, cmix = gibbs.component_draw(w, tmix, cmix, Counter(9, r, np.array([1])), None, None, np.ones(2), 1.0)
        seen.append((tmix[0], cmix))
    assert np.mean([s[0] for s in seen[10:]]) == pytest.approx(own.mean(), abs=0.04)
    assert np.mean([s[1] for s in seen[10:]]) == pytest.approx(300, rel=0.1)


def test_motif_finds_the_signal():
    rng = np.random.default_rng(4)
    codes, fore = rng.integers(0, 4, (4000, 9)), np.repeat([1, 0], 2000)
    codes[:2000, 4] = np.where(rng.random(2000) < 0.7, 2, codes[:2000, 4])
    motif = bias.learn_motif(codes, fore)
    assert set(motif.parents) == {4}
    assert motif.log_ratio(codes[:2000]).mean() > motif.log_ratio(codes[2000:]).mean()


def test_three_prime_rate(spark):
    rng = np.random.default_rng(6)
    k = rng.geometric(0.002, 4000) - 1
    rows = spark.createDataFrame([(int(x), 7000) for x in k if x < 7000], "tpdist int, tlen int")
    assert bias.three_prime_rate(rows) == pytest.approx(0.002, rel=0.1)


def test_length_model_falls_back(spark):
    m = bias.LengthModel.fit(spark.createDataFrame([(100, 5)], "length int, count long"))
    assert m.median == pytest.approx(200, abs=10) and m.cdf[-1] == pytest.approx(1)
    t = spark.createDataFrame([(0, 10), (1, 1000)], "tid int, exonic_length long")
    w = {r.tid: r.weight for r in weights.transcript_weights(t, m).collect()}
    assert w[0] == 25 and 700 < w[1] < 900


GTF = "".join(
    f'chr1\ts\texon\t{s}\t{e}\t.\t+\t.\tgene_id "{g}"; transcript_id "{t}";\n'
    for g, t, exons in (("G1", "A", [(101, 300), (401, 600)]), ("G1", "B", [(101, 300)]), ("G2", "C", [(2001, 2600)]), ("G3", "D", [(9001, 9100)]))
    for s, e in exons
)


def reads(n_a, n_c):
    line = lambda q, pos, cigar: f"{q}\t0\tchr1\t{pos}\t60\t{cigar}\t*\t0\t0\t*\t*\n"
    spliced = "".join(line(f"a{i}", 260 + i % 40, f"{41 - i % 40}M100N{9 + i % 40}M") for i in range(n_a))
    return "@HD\tVN:1.0\n" + spliced + "".join(line(f"c{i}", 2001 + i * 3, "50M") for i in range(n_c)) + line("m", 2100, "20M") + line("m", 120, "20M")


@pytest.fixture(scope="module")
def experiment(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("run")
    (d / "a.gtf").write_text(GTF)
    for i, (a, c) in enumerate([(20, 60), (24, 60), (60, 20), (66, 20)]):
        (d / f"{i}.sam").write_text(reads(a, c))
    return d


def test_counting(spark, experiment):
    exons = annotation.exons(annotation.read_gtf(spark, str(experiment / "a.gtf")))
    t = annotate.with_tid(annotate.transcript_table(exons))
    counts = analyze.count_reads(alignments.read_sam(spark, str(experiment / "0.sam")), t)
    assert {r.gene_id: r["count"] for r in counts.collect()} == {"G1": 20, "G2": 60, "G3": 0}
    forward = analyze.count_reads(alignments.read_sam(spark, str(experiment / "0.sam")), t, "reverse")
    assert {r["count"] for r in forward.collect()} == {0}


def test_analysis_end_to_end(spark, experiment):
    exons = annotation.exons(annotation.read_gtf(spark, str(experiment / "a.gtf")))
    samples = design.from_arguments(spark, [f"{experiment}/0.sam,{experiment}/1.sam", f"{experiment}/2.sam,{experiment}/3.sam"])
    rows = {i: alignments.read_sam(spark, f"{experiment}/{i}.sam") for i in range(4)}
    path = str(experiment / "store")
    analyze.run(spark, exons, samples, rows, path, analyze.Options(draws=4, burn_in=1, optimisation_rounds=1, seed=11))
    quant = registry.Store(spark, path).quant
    assert quant.select("draw").distinct().count() == 4 and quant.count() == 4 * 4 * 4
    genes = {(r["sample"], r.gene_id): r.estimate for r in registry.summarize(spark, path, "Gene_Expression").collect()}
    ratio = [genes[k, "G1"] / genes[k, "G2"] for k in range(4)]
    assert max(ratio[:2]) < 1 < 2 < min(ratio[2:])
    assert registry.summarize(spark, path, "differential-gene-expression").count() == 3
    for strategy in ("transcript-splicing", "condition-splicing", "experiment-splicing-sigma", "feature-expression", "gene-expression"):
        assert registry.summarize(spark, path, strategy, registry.Choices(credible=0.9)) is not None
    assert "2 conditions" in registry.report(spark, path)
    assert registry.trace(spark, path, "A").count() == 4
    with pytest.raises(ValueError, match="not alternatively"):
        registry.trace(spark, path, "C")
    with pytest.raises(ValueError, match="strategy"):
        registry.summarize(spark, path, "trace")


def test_streaming_summary(spark, tmp_path):
    from posterra.sources import store
    from posterra.streaming import running

    path = str(tmp_path / "s")
    for d in range(5):
        store.write(spark.createDataFrame([(d, 0, 7, float(d))], "draw int, sample int, tid int, value float"), path, "quant")
    q = running.write_table(running.running_mean(running.draws(spark, path)), str(tmp_path / "out"), str(tmp_path / "ck"), "complete")
    q.processAllAvailable()
    q.stop()
    assert [(r.n, r["mean"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(5, 2.0)]


def brute_fragmentation(n, lengths):
    """The sum over pieces of a transcript, one piece after the other."""
    p = 0.5 / lengths.median
    keep = 1 - p
    most = max(1, round(np.log(1e-5) / np.log(keep)))
    unbroken = [1.0] + [keep ** (m - 1) for m in range(1, most)]
    summed = [1.0]
    for m in range(1, most):
        summed.append(summed[-1] + keep ** (m - 1) / m)
    cdf = lambda h: lengths.cdf[h] if h < len(lengths.cdf) else 1.0
    run = lambda m: unbroken[m] if m < most else 0.0
    out = []
    for u in range(n):
        end = cdf(n - u + 1) / (n - u + 1)
        total = run(n - 1) / n * end
        total += sum(p * run(j - 1) / j * cdf(j - u) / (j - u) for j in range(u + 1, min(n, u + most)))
        total += sum(p * run(n - i - 1) / (n - i) * end for i in range(max(0, u - most), u))
        total += sum(p * p * cdf(h) / h * (summed[min(u + h, most - 1)] - summed[min(h, most - 1)]) for h in range(1, min(most, n - u)))
        out.append(3e5 * total / cdf(n - u))
    return np.array(out)


def test_fragmentation_profile():
    short = bias.LengthModel(np.array([0, 0.2, 0.5, 0.3]), 2)
    x = np.exp(-0.5 * ((np.arange(1001) - 200) / 100) ** 2)
    x[0] = 0
    long = bias.LengthModel(x / x.sum(), 200)
    for n in (1, 2, 5, 40, 130):
        for lengths in (short, long):
            assert bias.fragmentation_profile(n, lengths) == pytest.approx(brute_fragmentation(n, lengths), rel=1e-6)


def test_effective_length_against_every_fragment():
    rng = np.random.default_rng(8)
    lengths = bias.LengthModel(np.array([0, 0.0005, 0.3, 0.4, 0.2995]), 3)
    n = 9
    place = weights.place_factor(n, lengths, 0.05, True)
    assert place == pytest.approx(0.95 ** np.arange(n, 0, -1) * brute_fragmentation(n, lengths), rel=1e-6)
    sense, antisense, is_gc = rng.random(n), rng.random(n), rng.random(n) < 0.5
    gc = rng.random(15)
    want = 0.0005 * n
    for size in (2, 3, 4):
        for u in range(n - size + 1):
            share = is_gc[u : u + size].mean()
            want += lengths.pdf[size] * place[u] * sense[u] * antisense[u + size - 1] * bias.gc_factor(np.array([share]), gc)[0]
    got = weights.effective_length(n, lengths, place, sense, antisense, gc, is_gc)
    assert got == pytest.approx(max(25, want)) and got > 25


def test_genome_bias_changes_the_weights(spark, experiment):
    """A run with a genome: sequences are spliced and padded, models train, and every fragment keeps a finite weight."""
    from posterra.model import library

    rng = np.random.default_rng(9)
    genome = spark.createDataFrame([("chr1", "".join(rng.choice(list("ACGT"), 200_000)))], "seqname string, seq string")
    exons = annotation.exons(annotation.read_gtf(spark, str(experiment / "a.gtf")))
    t = annotate.with_tid(annotate.transcript_table(exons))
    s = {r.transcript_id: r for r in library.with_sequences(t, genome).collect()}
    whole = genome.first().seq
    assert s["A"].sequence == whole[85:300] + whole[400:615] and len(s["C"].sequence) == 600 + 30
    rows = alignments.read_sam(spark, str(experiment / "0.sam"))
    plain, _, none = analyze.likelihood(rows, t, analyze.Options(fragmentation=False))
    matrix, sizes, models = analyze.likelihood(rows, library.with_sequences(t, genome), analyze.Options(), genome)
    assert none.gc is None and models.gc is not None and len(models.gc) == 15 and models.motifs is not None and models.fragmentation
    got, base = ({(r.tid, r.frag): r.w for r in m.collect()} for m in (matrix, plain))
    assert set(got) <= set(base) and len(got) > 50 and all(np.isfinite(w) and w > 0 for w in got.values())
    assert got != base and all(r.weight >= 25 for r in sizes.collect())
    tiled = bias.tiles(genome, 10, 1000).collect()
    assert all(r.seq == whole[r["first"] : r.tile * 1000 + 1010] and r["first"] == max(0, r.tile * 1000 - 10) for r in tiled) and len(tiled) == 200


def test_training_sequences(spark, experiment):
    exons = annotation.exons(annotation.read_gtf(spark, str(experiment / "a.gtf")))
    t = annotate.with_tid(annotate.transcript_table(exons))
    rows = alignments.read_sam(spark, str(experiment / "0.sam"))
    other = spark.createDataFrame([("chr9",)], "seqname string")
    models = analyze.likelihood(rows, t, analyze.Options(strandedness="forward"), training=other)[2]
    assert models.specificity == 0.5 and models.three_prime == 0.0


def test_optimising_reaches_the_maximum():
    """Against a fine grid of the likelihood, dense and sparse alike."""
    rng = np.random.default_rng(12)
    w = rng.random((2, 300)) * (rng.random((2, 300)) < 0.7)
    w[0, w.sum(axis=0) == 0] = 0.5
    counter = lambda: Counter(1, 0, np.array([5]))
    tmix, cmix = gibbs.component_draw(w, np.array([0.5, 0.5]), 10.0, counter(), None, None, np.ones(2), 1.0, optimise=True)
    grid = np.linspace(0.001, 0.999, 999)
    best = grid[np.argmax([np.log(x * w[0] + (1 - x) * w[1]).sum() for x in grid])]
    assert tmix[0] == pytest.approx(best, abs=2e-3) and tmix.sum() == pytest.approx(1) and cmix == pytest.approx(300, rel=1e-3)


def test_large_component_is_sparse():
    """A component of 100,000 fragments and 2,000 transcripts, whose dense matrix would take 1.6 GB."""
    import tracemalloc

    rng = np.random.default_rng(13)
    frag = np.arange(100_000)
    row, column = np.concatenate((frag % 2000, (frag * 7) % 2000)), np.concatenate((frag, frag))
    weights_ = gibbs.Sparse.of(row, column, rng.random(200_000) + 0.1, 2000, 100_000)
    tracemalloc.start()
    tmix, _ = gibbs.component_draw(weights_, np.full(2000, 1 / 2000), 1e5, Counter(2, 0, np.array([1])), None, None, np.ones(2000), 1.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6 and tmix.sum() == pytest.approx(1) and (tmix >= 0).all()


def test_quality_report(spark, experiment):
    exons = annotation.exons(annotation.read_gtf(spark, str(experiment / "a.gtf")))
    samples = design.from_arguments(spark, [f"{experiment}/0.sam"])
    found = {}
    analyze.run(spark, exons, samples, {0: alignments.read_sam(spark, f"{experiment}/0.sam")}, str(experiment / "qc"), analyze.Options(dry_run=True), quality=found)
    assert found[0]["fragments"] == 81 and found[0]["gc_bins"] is None and 0.99 < sum(p for _, p in found[0]["fragment_length_pmf"]) <= 1
    from posterra.sources import store

    store.write_yaml(str(experiment / "qc.yaml"), found)
    import yaml

    assert yaml.safe_load((experiment / "qc.yaml").read_text())[0]["strand_specificity"] == 0.5


def test_simplex_densities():
    a, x = np.array([2.0, 3.0, 1.5]), np.array([0.2, 0.5, 0.3])
    from math import gamma, log, pi

    assert D.dirichlet(x, a) == pytest.approx(log(gamma(6.5) / (gamma(2) * gamma(3) * gamma(1.5)) * 0.2 * 0.5**2 * 0.3**0.5))
    y = np.log(x[:2] / x[2])
    assert D.logistic_normal(x, np.zeros(2), np.ones(2)) == pytest.approx(-log(2 * pi) - 0.5 * (y**2).sum() - log(0.2 * 0.5 * 0.3))


def test_sessions_of_a_stream(spark, tmp_path):
    from posterra.streaming import running

    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:04:00"), ("a", "2024-01-01 01:00:00"), ("b", "2024-01-01 00:01:00")]
    spark.createDataFrame(rows, "k string, t string").selectExpr("k", "cast(t as timestamp) as t").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, t timestamp").parquet(str(tmp_path / "in"))
    q = running.clusters(stream, "t", "k", "10 minutes", "1 day").writeStream.outputMode("complete").format("memory").queryName("sessions_seen").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.k, r.n) for r in spark.sql("select * from sessions_seen").collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_giant_components_agree_with_one_task(spark):
    """A component drawn by assigning its fragments has the posterior means of the sampler that sees it whole, with and without priors."""
    from posterra.model import giants

    rng = np.random.default_rng(5)
    n, fragments_ = 6, 300
    truth = rng.dirichlet(np.ones(n))
    rows = [(0, 0, int(t), f"f{i}", float(w)) for i in range(fragments_) for t in rng.choice(n, 3, replace=False, p=truth) for w in [rng.uniform(0.2, 1.0)]]
    weights_ = spark.createDataFrame(rows, "sample int, component long, tid int, frag string, w double").cache()
    state = spark.createDataFrame(
        [(0, 0, t, 1 / n, 300.0, 1.0, 300.0, 0.2, 2.0) for t in range(n)], "sample int, component long, tid int, tmix double, cmix double, effective double, total double, prior_mean double, prior_shape double"
    )
    small, large, keys = giants.split(weights_, 100)
    assert small.count() == 0 and large.count() == len(rows) and keys.count() == 1 and giants.split(weights_)[1] is None
    got = weights_.toPandas()
    matrix = gibbs.Sparse.of(got["tid"].to_numpy(), np.unique(got["frag"], return_inverse=True)[1], got["w"].to_numpy(), n, fragments_)
    ones = np.ones(n)
    p = got.assign(p=0.0)
    for priors in (False, True):
        mean, shape = (np.full(n, 0.2), np.full(n, 2.0)) if priors else (None, None)
        whole, split_, cmix = [], [], 300.0
        tmix = np.full(n, 1 / n)
        for r in range(1500):
            tmix, cmix = gibbs.component_draw(matrix, tmix, cmix, Counter(3, r, np.array([1])), mean, shape, ones, 300.0)
            whole.append(tmix)
        tmix, cmix = np.full(n, 1 / n), 300.0
        for r in range(3000):
            # the assignment of one sweep, in numpy, by the rule that the columns follow
            p["p"] = np.log(tmix[p["tid"]] * p["w"]) - np.log(-np.log(rng.uniform(size=len(p))))
            counts = np.bincount(p.loc[p.groupby("frag")["p"].idxmax(), "tid"], minlength=n).astype(float)
            tmix = giants.traded(counts, tmix, cmix, np.arange(n), 4, r, mean, shape, ones, 300.0, False)
            cmix = gibbs.abundance_draw(fragments_, tmix, cmix, Counter(6, r, np.array([1])), mean, shape, ones, 300.0)
            split_.append(tmix)
        assert np.mean(split_[100:], axis=0) == pytest.approx(np.mean(whole[100:], axis=0), abs=0.02)
        assert np.std(split_[100:], axis=0) == pytest.approx(np.std(whole[100:], axis=0), abs=0.015)
    out = giants.sample_giants(large, state, 1, 0, True, sweeps=1).toPandas()
    assert out["tmix"].sum() == pytest.approx(1) and sorted(out["tid"]) == list(range(n)) and out["cmix"].nunique() == 1
    again = giants.sample_giants(large.repartition(3), state.repartition(2), 1, 0, True, sweeps=1).toPandas()
    assert out.sort_values("tid")["tmix"].tolist() == again.sort_values("tid")["tmix"].tolist()
    counts = giants.assigned(large, state, 1, 0, False)
    assert counts.agg(F.sum("got")).first()[0] == fragments_
    expected = giants.assigned(large, state, 1, 0, True).agg(F.sum("got")).first()[0]
    assert expected == pytest.approx(fragments_)


def test_draws_are_written_in_batches_and_whole(spark, tmp_path):
    from posterra.sources import store

    path = str(tmp_path / "s")
    frame = lambda draw: {t: spark.range(4).selectExpr(f"{draw} as draw", "cast(id % 2 as int) as sample", "cast(id as int) as tid", "0.5D as value", "1.0D as scale") for t in ("quant", "scaling")}
    sink = store.Draws(spark, path, batch=3)
    for draw in range(7):
        sink.add(frame(draw))
    assert {r.draw for r in store.read(spark, path, "quant").collect()} == set(range(6))
    # a run that stops while it writes leaves draws that are not read
    store.write(frame(6)["quant"], path, "quant")
    assert store.read(spark, path, "quant").count() == 24
    files = list((tmp_path / "s" / "quant").rglob("*.parquet"))
    assert len(files) <= 2 * 2 + 2 * 8
    sink = store.Draws(spark, path, batch=3)
    assert store.read(spark, path, "quant").count() == 0
    sink.add(frame(0))
    sink.flush()
    sink.flush()
    assert {r.draw for r in store.read(spark, path, "quant").collect()} == {0} and store.read(spark, path, "scaling").count() == 4


def test_motif_differences(spark):
    """How two libraries' bias differs over the first exonic positions, against a loop over them."""
    from posterra.model import library
    from posterra.sources import fasta

    rng = np.random.default_rng(8)
    seqs = {f"chr{i}": "".join(rng.choice(list("ACGTN"), 90_000, p=[0.3, 0.2, 0.2, 0.29, 0.01])) for i in (2, 10)}
    tiles = fasta.tiles_of(spark.createDataFrame(list(seqs.items()), "seqname string, seq string"))
    one = lambda *w: bias.Motif({15: ()}, {15: (np.log(np.array([w])), np.log(np.full((1, 4), 0.25)))}, 31)
    lengths = bias.LengthModel(np.array([0, 1.0]), 1)
    libraries = {
        0: library.Library(lengths, motifs=(one(0.4, 0.1, 0.2, 0.3), one(0.25, 0.25, 0.25, 0.25))), 1: library.Library(lengths),
        4: library.Library(lengths, motifs=(one(0.1, 0.4, 0.2, 0.3), one(0.3, 0.2, 0.25, 0.25))), 7: library.Library(lengths, motifs=(one(0.25, 0.25, 0.25, 0.25),) * 2),
    }
    exons = [("chr2", 0, 99, 1), ("chr2", 50, 300, 2), ("chr2", 65_400, 65_700, 1), ("chr10", 10, 500, 3), ("chr10", 600, 700, 3)]
    got = library.motif_differences(spark.createDataFrame(exons, "seqname string, start long, end long, tid int"), tiles, libraries, 1000)
    windows = [seqs[c][p - 15 : p + 16] for c, s, e in (("chr2", 0, 300), ("chr2", 65_400, 65_700), ("chr10", 10, 500)) for p in range(s, e + 1) if p >= 15]
    windows = bias.encode([w for w in windows if "N" not in w])
    want = [(a, b, sum(np.abs(x.log_ratio(windows) - y.log_ratio(windows)) / np.log(2) for x, y in zip(libraries[a].motifs, libraries[b].motifs, strict=True)).mean()) for a, b in ((0, 4), (0, 7), (4, 7))]
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want])
    assert library.motif_differences(spark.createDataFrame(exons, "seqname string, start long, end long, tid int"), tiles, {0: libraries[0], 1: libraries[1]}) == []


def test_command_line_with_a_genome(spark, experiment):
    """A dry run from files: the genome is read in lines, both libraries train, and the report compares their sequence bias."""
    import yaml

    from posterra import cli

    rng = np.random.default_rng(12)
    letters = "".join(rng.choice(list("ACGT"), 200_000))
    (experiment / "g.fa").write_text(">chr1 made\n" + "\n".join(letters[i : i + 70] for i in range(0, len(letters), 70)) + "\n")
    reads_ = f"{experiment}/0.sam,{experiment}/1.sam"
    assert cli.main(["analyze", str(experiment / "a.gtf"), reads_, "-o", str(experiment / "dry"), "--genome", str(experiment / "g.fa"), "--qc", str(experiment / "dry.yaml"), "-n", "--no-fragmentation"]) == 0
    found = yaml.safe_load((experiment / "dry.yaml").read_text())
    assert [x[:2] for x in found["motif_difference"]] == [[0, 1]] and len(found[0]["gc_bins"]) == 15 and found[1]["motif_places"] == [[], []]
