"""Relational operators: intervals, graphs, ranks, fragments; DataFrame in, DataFrame out."""
