"""Summaries of posterior draws and the catalogue of queries over the driver's tables."""
