"""Readers with explicit schemas, and writers that do all formatting."""
