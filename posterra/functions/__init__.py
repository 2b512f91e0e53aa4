"""Column functions: order statistics, safe arithmetic, sequences, CIGAR strings."""
