"""From annotation and alignments to a posterior store, and read counting."""

from __future__ import annotations

import datetime
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import __version__
from ..functions import cigar as C
from ..operators import annotation, components, fragments, scaling
from ..plans import registry
from ..session import checkpointed
from ..sources import store
from . import giants, gibbs, library, weights


@dataclass
class Options:
    draws: int = 350
    burn_in: int = 50
    optimisation_rounds: int = 30
    seed: int = gibbs.SEED
    strandedness: str = "none"
    library: str = "FR"
    least_alignment_pr: float = 0.1
    use_priors: bool = True
    exclude: tuple[str, ...] = ()
    dry_run: bool = False
    fragmentation: bool = True
    largest_component: int = giants.LARGEST
    priors: gibbs.Priors = field(default_factory=gibbs.Priors)


def fragment_rows(alignments: DataFrame, library: str = "FR") -> DataFrame:
    """(frag, qname, seqname, strand, start, end, blocks1, blocks2, align_pr, plain) of the valid pairs and single reads; ``plain`` pairs align in one piece each."""
    ops = C.operations(F.col("cigar"))
    hit = F.coalesce(F.try_element_at("tags", F.lit("HI")).try_cast("int"), F.lit(0))
    rows = alignments.withColumn("ops", ops).withColumns({"alnnum": hit, "blocks": C.aligned_blocks(F.col("pos"), F.col("ops"))})
    wrong = C.misaligned_probability(C.mismatches(F.col("tags"), F.try_element_at("tags", F.lit("MD"))), F.length("seq"))
    rows = rows.where(F.size("blocks") > 0).select(
        "qname", "rname", "flag", "pos", (F.element_at("blocks", -1)["end"]).alias("end"), "alnnum", F.struct("blocks", (1 - wrong).alias("pr"), (F.size("ops") == 1).alias("plain")).alias("cigar")
    )
    pairs = fragments.mate_pairs(rows, library)
    second = F.col("mate2")
    strand = fragments.fragment_strand(C.has_flag(F.col("mate1.flag"), C.REVERSE), F.lit(False))
    return pairs.select(
        F.concat_ws(":", "qname", "rname", "mate1.pos", "mate1.alnnum", F.coalesce(second["pos"], F.lit(-1))).alias("frag"), "qname", F.col("rname").alias("seqname"), strand.alias("strand"),
        F.least("mate1.pos", F.coalesce(second["pos"], F.col("mate1.pos"))).alias("start"), F.greatest("mate1.end", F.coalesce(second["end"], F.col("mate1.end"))).alias("end"),
        F.col("mate1.cigar.blocks").alias("blocks1"), second["cigar"]["blocks"].alias("blocks2"), (F.col("mate1.cigar.pr") * F.coalesce(second["cigar"]["pr"], F.lit(1.0))).alias("align_pr"),
        (F.col("mate1.cigar.plain") & F.coalesce(second["cigar"]["plain"], F.lit(False))).alias("plain"),
    )


def count_reads(alignments: DataFrame, transcripts: DataFrame, strandedness: str = "none", library: str = "FR") -> DataFrame:
    """(gene_id, count): uniquely mapped fragments that fit transcripts of one gene only; genes without any keep 0."""
    usable = fragments.uniquely_mapped(fragments.mapped(alignments))
    t = transcripts.select("tid", "gene_id", "seqname", F.col("strand").alias("t_strand"), "min_start", "max_end", "exons")
    pairs = fragments.compatibility(fragment_rows(usable, library), t, strandedness)
    return fragments.gene_counts(pairs, transcripts)


def likelihood(alignments: DataFrame, transcripts: DataFrame, options: Options, genome: DataFrame | None = None, training: DataFrame | None = None) -> tuple[DataFrame, DataFrame, library.Library]:
    """(tid, frag, w) of one sample, (tid, weight), and the library's models; ``transcripts`` has ``sequence`` if there is a genome."""
    usable = fragments.properly_paired(fragments.mapped(alignments, options.exclude))
    t = transcripts.select("tid", "gene_id", "seqname", F.col("strand").alias("t_strand"), "min_start", "max_end", "exons")
    pairs = library.placed(fragments.compatibility(fragment_rows(usable, options.library), t, options.strandedness))
    pairs = checkpointed(pairs.select("frag", "qname", "seqname", "strand", "start", "end", "tid", "t_strand", "frag_len", "five", "align_pr", "plain"))
    models = library.train(pairs, transcripts, options.strandedness != "none", genome, options.fragmentation, training, options.seed)
    effective = library.effective_lengths(transcripts, models)
    rows = pairs.select("frag", "qname", "tid", F.col("seqname").alias("locus"), "align_pr", "frag_len", (F.col("strand") == F.col("t_strand")).alias("agrees"))
    rows = rows.join(library.fragment_bias(pairs, transcripts, models), ["frag", "tid"])
    w = weights.fragment_weights(rows, effective, models.lengths, models.specificity)
    full = w.join(rows.select("frag", "tid", "qname", "locus", "align_pr"), ["frag", "tid"])
    matrix = weights.weight_matrix(full.select(F.col("qname").alias("frag"), "tid", F.col("frag").alias("locus"), "align_pr", "w"), options.least_alignment_pr)
    return matrix, effective, models


def run(
    spark: SparkSession, exons: DataFrame, samples: DataFrame, alignments: dict[int, DataFrame], path: str, options: Options | None = None, command: str = "",
    genome: DataFrame | None = None, training: DataFrame | None = None, quality: dict | None = None,
) -> None:
    """Analyse an experiment and write every draw to the store at ``path``.

    samples: the design table; alignments: alignment rows by sample number; genome: tiles or (seqname,
    seq), without which sequence and GC bias are not corrected; training: (seqname) that bias
    models learn from, none: all; quality: gets a report for each sample and, with a genome, how their
    sequence bias differs.
    """
    options, began = options or Options(), time.time()
    transcripts = checkpointed(annotation.with_gene_tgroup(annotation.with_tid(annotation.transcript_table(exons))))
    tids = transcripts.select("tid", "transcript_id", "seqname", "strand")
    placed = exons.join(tids.select("tid", "transcript_id"), "transcript_id").select("tid", "seqname", "strand", "start", "end")
    store.write(transcripts, path, "transcripts", "overwrite")
    store.write(annotation.features(placed), path, "features", "overwrite")
    store.write(samples.select("sample", F.col("sample_name").alias("name"), "filename", "condition", "condition_name"), path, "samples", "overwrite")
    models = transcripts if genome is None else checkpointed(library.with_sequences(transcripts, genome))
    parts, effective, libraries = [], [], {}
    for number, rows in sorted(alignments.items()):
        matrix, sizes, learned = likelihood(rows, models, options, genome, training)
        libraries[number] = learned
        if quality is not None:
            quality[number] = registry.quality_report(matrix.select("frag", "tid"), learned)
        parts.append(matrix.withColumn("sample", F.lit(number)))
        effective.append(sizes.withColumn("sample", F.lit(number)))
    if quality is not None and genome is not None:
        quality["motif_difference"] = [[a, b, x] for a, b, x in library.motif_differences(placed, genome, libraries)]
    merge = lambda frames: frames[0] if len(frames) == 1 else merge([frames[0].unionByName(frames[1]), *frames[2:]])
    matrix, sizes = checkpointed(merge(parts)), checkpointed(merge(effective))
    if options.dry_run:
        return
    labels = components.fragment_components(matrix, transcripts.select("tid", "tgroup"))
    matrix = checkpointed(matrix.join(labels, ["sample", "tid"]))
    fitting, large, large_keys = giants.split(matrix, options.largest_component)
    loads = matrix.groupBy("sample", "component").agg(F.count_distinct("frag").alias("fragments"))
    base = matrix.select("sample", "component", "tid").distinct().join(loads, ["sample", "component"]).join(sizes, ["sample", "tid"])
    n_in = F.count(F.lit(1)).over(Window.partitionBy("sample", "component"))
    state = checkpointed(base.select("sample", "component", "tid", (1.0 / n_in).alias("tmix"), (F.col("fragments") + 1.0).alias("cmix"), F.col("weight").alias("effective")))
    n = transcripts.count()
    conditions = samples.select("sample", "condition")
    least = options.priors.least_expression / n
    every = transcripts.select("tid").crossJoin(conditions)
    levels = checkpointed(transcripts.select("tid").crossJoin(conditions.select("condition").distinct()).select("tid", "condition", F.lit(1.0 / n).alias("mean"), F.lit(1.0).alias("shape"), F.lit(1.0 / n).alias("experiment_mean")))
    splicing = None
    sink = store.Draws(spark, path)
    shape_beta = splice_beta = 1.0
    sigma = 0.5
    rounds = options.optimisation_rounds + 1 + options.burn_in + max(0, options.draws - 1)
    for r in range(rounds):
        priors_on = options.use_priors and r > options.optimisation_rounds
        draw = 0 if r == options.optimisation_rounds else r - options.optimisation_rounds - options.burn_in
        total = state.groupBy("sample").agg(F.sum(F.col("tmix") * F.col("cmix") / F.col("effective")).alias("total"))
        prior = levels.join(conditions, "condition").select("sample", "tid", F.col("mean").alias("prior_mean"), F.col("shape").alias("prior_shape"))
        full = state.join(total, "sample").join(prior, ["sample", "tid"])
        # up to the first draw that is kept, mixtures go to the maximum of their posterior
        drawn = gibbs.sample_components(fitting, full if large is None else full.join(large_keys, giants.KEY, "left_anti"), options.seed, r, priors_on, r <= options.optimisation_rounds)
        if large is not None:
            drawn = drawn.unionByName(giants.sample_giants(large, checkpointed(full.join(large_keys, giants.KEY, "left_semi")), options.seed, r, priors_on, r <= options.optimisation_rounds))
        state = checkpointed(drawn.join(state.select("sample", "tid", "effective"), ["sample", "tid"]).select("sample", "component", "tid", "tmix", "cmix", "effective"))
        shares = weights.expression(state.withColumnRenamed("effective", "weight"))
        values = every.join(shares, ["sample", "tid"], "left").select("sample", "condition", "tid", F.greatest(F.coalesce("value", F.lit(0.0)), F.lit(least)).alias("value"))
        scale = scaling.quantile_scale(values, by=())
        values = checkpointed(values.join(scale, "sample").select("sample", "condition", "tid", (F.col("value") * F.col("scale")).alias("value")))
        if priors_on:
            shape_beta = gibbs.sample_beta(levels, "shape", options.priors.condition_shape_alpha, options.priors.shape_beta_alpha, options.priors.shape_beta_beta, shape_beta, options.seed, r)
        levels = checkpointed(gibbs.sample_means(values, levels, options.seed, r, shape_beta, options.priors, priors_on))
        splicing, splice_beta, sigma = _splice(values, transcripts, splicing, options, r, splice_beta, sigma, priors_on)
        if draw == 0 and r == options.optimisation_rounds or draw > 0:
            sink.add(_tables(draw, values, scale, levels, splicing, sigma))
    sink.flush()
    stamp = datetime.datetime.now(datetime.timezone.utc).strftime("%a, %d %b %Y %T %z")
    info = [(command, __version__, "", stamp, f"{time.time() - began:.1f}", options.seed)]
    store.write(spark.createDataFrame(info, "command_line string, version string, commit string, date string, elapsed_seconds string, rng_seed long"), path, "run_metadata", "overwrite")


def _splice(values, transcripts, state, options, r, beta, sigma, on):
    rows = values.join(transcripts.select("tid", "tgroup"), "tid")
    w = Window.partitionBy("sample", "tgroup")
    rows = rows.withColumns({"n": F.count(F.lit(1)).over(w), "value": F.col("value") / F.sum("value").over(w)}).where("n > 1").select("tid", "condition", "sample", "value")
    if state is None:
        state = rows.select("tid", "condition").distinct().select("tid", "condition", F.lit(0.5).alias("mu"), F.lit(0.1).alias("spread"), F.lit(0.5).alias("experiment_mu"))
    if on:
        beta = gibbs.sample_beta(state, "spread", options.priors.splice_alpha, 3.0, 50.0, beta, options.seed, r)
        sigma = gibbs.sample_sigma(state, sigma, options.seed, r)
    return checkpointed(gibbs.sample_splicing(rows, state, options.seed, r, beta, sigma, options.priors).join(transcripts.select("tid", "tgroup"), "tid")), beta, sigma


def _tables(draw, values, scale, levels, splicing, sigma) -> dict[str, DataFrame]:
    """The rows of one draw, by table of the store; all come from frames that are kept in the shared folder."""
    at = F.lit(draw).alias("draw")
    by_transcript = lambda rows, *columns: rows.select(at, *columns).distinct()
    return {
        "quant": values.select(at, "sample", "tid", "value"),
        "scaling": checkpointed(scale.select(at, "sample", "scale")),
        "condition_mean": levels.select(at, "condition", "tid", F.col("mean").alias("value")),
        "condition_shape": by_transcript(levels, "tid", F.col("shape").alias("value")),
        "experiment_mean": by_transcript(levels, "tid", F.col("experiment_mean").alias("value")),
        "condition_splice_mu": splicing.select(at, "condition", "tgroup", "tid", F.col("mu").alias("value")),
        "condition_splice_sigma": by_transcript(splicing, "tgroup", "tid", F.col("spread").alias("value")),
        "experiment_splice_mu": by_transcript(splicing, "tgroup", "tid", F.col("experiment_mu").alias("value")),
        "experiment_splice_sigma": by_transcript(splicing, "tgroup", "tid", F.lit(sigma).alias("value")),
    }
