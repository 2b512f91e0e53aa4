"""Command line: analyze, summarize, describe, trace, count."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from . import session as sessions
from .model import analyze, gibbs
from .operators import annotation as annotate
from .plans import registry
from .sources import alignments, annotation, design, fasta, store


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="posterra")
    sub = out.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze", help="annotation and reads to a posterior store")
    a.add_argument("annotation")
    a.add_argument("reads", nargs="+", help="a YAML design, or one argument a condition with comma-separated files")
    a.add_argument("-o", "--output", default="posterra-store")
    a.add_argument("-n", "--dry-run", action="store_true")
    a.add_argument("-s", "--seed", type=int, default=gibbs.SEED)
    a.add_argument("-N", "--num-samples", type=int, default=350)
    a.add_argument("-B", "--burn-in", type=int, default=50)
    a.add_argument("--rounds", type=int, default=30, help="optimisation rounds before the first draw")
    a.add_argument("--introns", action="store_true")
    a.add_argument("--exons", action="store_true")
    a.add_argument("--strand", choices=("none", "forward", "reverse"), default="none")
    a.add_argument("--min-align-pr", type=float, default=0.1)
    a.add_argument("--exclude-seqs", default="")
    a.add_argument("--qc", help="YAML file for what was learned of each sample")
    a.add_argument("--genome", help="FASTA file, from which sequence and GC bias are learned")
    a.add_argument("--bias-training-seqs", help="file of names of the sequences that bias models learn from")
    a.add_argument("--no-fragmentation", action="store_true", help="no correction for random fragmentation")
    a.add_argument("--no-priors", action="store_true")
    for name, default in vars(gibbs.Priors()).items():
        a.add_argument(f"--{name.replace('_', '-')}", type=float, default=default)
    s = sub.add_parser("summarize", help="a table from a posterior store")
    s.add_argument("strategy", nargs="?")
    s.add_argument("store", nargs="?")
    s.add_argument("-o", "--output")
    s.add_argument("-l", "--list", action="store_true")
    s.add_argument("--normalize", action="store_true")
    s.add_argument("--credible", type=float)
    s.add_argument("--effect-size", type=float)
    s.add_argument("--groups")
    d = sub.add_parser("describe", help="what a posterior store holds")
    d.add_argument("store")
    t = sub.add_parser("trace", help="all draws of one transcript's splicing")
    t.add_argument("store")
    t.add_argument("transcript")
    t.add_argument("-o", "--output", default="trace.tsv")
    c = sub.add_parser("count", help="fragments by gene")
    c.add_argument("reads")
    c.add_argument("annotation")
    c.add_argument("-o", "--output", default="-")
    c.add_argument("-s", "--stranded", choices=("none", "forward", "reverse"), default="none")
    c.add_argument("-t", "--type", default="exon")
    c.add_argument("-i", "--id", default="gene_id")
    c.add_argument("-I", "--transcript-id", default="transcript_id")
    return out


def _exons(spark, args):
    if args.exons:
        return annotation.read_exon_list(spark, args.annotation)
    return annotation.read_introns(spark, args.annotation) if args.introns else annotation.exons(annotation.read_gtf(spark, args.annotation))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "summarize" and args.list:
        print("\n".join(sorted(registry.STRATEGIES)))
        return 0
    spark = sessions.session()
    if args.command == "analyze":
        head = alignments.head_of(spark, args.reads[0].split(",")[0], 8192)
        if len(args.reads) == 1 and not alignments.is_sam(head) and not alignments.is_bam(head):
            samples = design.from_yaml(spark, "\n".join(r.value for r in spark.read.text(args.reads[0], wholetext=True).collect()))
        else:
            samples = design.from_arguments(spark, args.reads)
        reads = {r.sample: alignments.read_alignments(spark, r.filename) for r in samples.collect()}
        priors = gibbs.Priors(**{k: getattr(args, k) for k in vars(gibbs.Priors())})
        options = analyze.Options(
            args.num_samples, args.burn_in, args.rounds, args.seed, args.strand, "FR", args.min_align_pr, not args.no_priors, tuple(x for x in args.exclude_seqs.split(",") if x), args.dry_run, not args.no_fragmentation, priors
        )
        genome = sessions.checkpointed(fasta.read_tiles(spark, args.genome)) if args.genome else None
        training = annotation.read_names(spark, args.bias_training_seqs) if args.bias_training_seqs else None
        analyze.run(spark, _exons(spark, args), samples, reads, args.output, options, " ".join(argv or sys.argv), genome, training, quality := {} if args.qc else None)
        if args.qc:
            store.write_yaml(args.qc, quality)
    elif args.command == "summarize":
        out = registry.summarize(spark, args.store, args.strategy, registry.Choices(args.credible, args.effect_size, args.normalize, args.groups))
        store.write_tsv(out, args.output or f"{args.strategy}.tsv")
    elif args.command == "describe":
        print(registry.report(spark, args.store))
    elif args.command == "trace":
        store.write_tsv(registry.trace(spark, args.store, args.transcript), args.output, ["round"])
    else:
        exons = annotation.exons(annotation.read_gtf(spark, args.annotation), args.type, args.transcript_id, args.id)
        transcripts = annotate.with_tid(annotate.transcript_table(exons))
        counts = analyze.count_reads(alignments.read_alignments(spark, args.reads), transcripts, args.stranded)
        counts = counts.select(F.col("gene_id").alias("id"), "count")
        if args.output == "-":
            for row in counts.orderBy("id").toLocalIterator():
                print(f"{row['id']}\t{row['count']}")
        else:
            store.write_tsv(counts, args.output, ["id"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
