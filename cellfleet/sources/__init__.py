"""Scans with explicit schemas, and sinks that never overwrite."""
