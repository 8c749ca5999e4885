"""Scans and sinks: corpus JSON, metadata and label CSV, vector and assignment tables."""
