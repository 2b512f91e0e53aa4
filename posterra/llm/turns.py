"""Rows of conversations in order, without bringing a conversation into one task.

Rows are dealt by ranges of (conversation, turn, ...), so that a conversation of any length is cut
over neighbouring tasks; only the first and the last conversation of a task may go on in another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import partitions


def in_order(rows: DataFrame, key: str, *by: Column) -> DataFrame:
    """``rows`` sorted over all partitions by ``key`` and ``by``, nulls first."""
    order = [F.col(key), *by]
    return rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)


def changes(keys: pa.Array) -> np.ndarray:
    """Where the runs of equal keys begin, nulls being equal; the first row begins one."""
    valid = np.asarray(keys.is_valid())
    values = np.asarray(keys.fill_null(0))
    return np.flatnonzero(np.concatenate(([True], (values[1:] != values[:-1]) | (valid[1:] != valid[:-1]))))[: len(keys)]
