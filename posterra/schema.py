"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

GTF_RAW = "seqname string, source string, feature string, start string, end string, score string, strand string, frame string, attributes string"
GTF = "seqname string, source string, feature string, start long, end long, score double, strand string, frame int, attributes map<string,string>"
BED = "seqname string, start long, end long, name string, score string, strand string"
ALIGNMENT = "qname string, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, qual string, tags map<string,string>"
SEQUENCE = "seqname string, seq string"
DESIGN = "sample int, condition int, condition_name string, sample_name string, filename string"
GROUPS = "group int, position int, transcript_id string"

STORE = {
    "transcripts": "tid int, transcript_id string, gene_id string, gene_name string, tgroup int",
    "samples": "sample int, name string, filename string, condition int, condition_name string",
    "committed": "draw int",
    "quant": "draw int, sample int, tid int, value float",
    "scaling": "draw int, sample int, scale float",
    "condition_mean": "draw int, condition int, tid int, value float",
    "condition_shape": "draw int, tid int, value float",
    "experiment_mean": "draw int, tid int, value float",
    "condition_splice_mu": "draw int, condition int, tgroup int, tid int, value float",
    "experiment_splice_mu": "draw int, tgroup int, tid int, value float",
    "condition_splice_sigma": "draw int, tgroup int, tid int, value float",
    "experiment_splice_sigma": "draw int, tgroup int, tid int, value float",
    "features": "feature_id int, seqname string, start long, end long, strand string, type string, including array<int>, excluding array<int>",
    "run_metadata": "command_line string, version string, commit string, date string, elapsed_seconds string, rng_seed long",
}
#: Columns that a table's files are split by.
PARTITIONED = {"quant": ["sample"], "condition_mean": ["condition"], "condition_splice_mu": ["condition"]}
