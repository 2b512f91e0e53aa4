"""Draws as a stream: running summaries while a sampler appends to its store."""
