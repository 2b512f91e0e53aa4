"""Bias models, fragment weights, and the hierarchical sampler."""
