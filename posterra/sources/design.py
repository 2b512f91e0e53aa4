"""Experiment designs: a YAML map of conditions, or one argument a condition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schema


def _frame(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """Number samples in order, conditions by first appearance."""
    conditions: dict[str, int] = {}
    out = [(i, conditions.setdefault(c, len(conditions)), c, name, f) for i, (c, name, f) in enumerate(rows)]
    return spark.createDataFrame(out, schema.DESIGN)


def from_yaml(spark: SparkSession, text: str) -> DataFrame:
    """condition: {sample: file} or condition: [file, ...]; anything else is an error."""
    import yaml

    design = yaml.safe_load(text)
    if not isinstance(design, dict):
        raise ValueError("a design is a map of conditions")
    rows = []
    for condition, members in design.items():
        if isinstance(members, dict):
            rows += [(str(condition), str(name), str(f)) for name, f in members.items()]
        elif isinstance(members, list) and all(isinstance(f, str) for f in members):
            rows += [(str(condition), f"{condition}-{i}", f) for i, f in enumerate(members, 1)]
        else:
            raise ValueError(f"condition {condition!r} is neither a map nor a list of files")
    return _frame(spark, rows)


def from_arguments(spark: SparkSession, arguments: list[str]) -> DataFrame:
    """Each argument is a condition, its comma-separated files the replicates."""
    rows = [(f"condition-{i}", f"condition-{i}-{j}", f) for i, a in enumerate(arguments, 1) for j, f in enumerate(a.split(","), 1)]
    return _frame(spark, rows)
