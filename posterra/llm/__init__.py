"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it. Each module holds one operator
with a general interface; ``queries`` binds the operators to the driver's
tables, ``oracles`` holds the DuckDB statements of those that SQL can express.
"""
