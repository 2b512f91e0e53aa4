"""PySpark analytics over posterior draws, genomic intervals and sequencing reads."""

__version__ = "0.1.0"
