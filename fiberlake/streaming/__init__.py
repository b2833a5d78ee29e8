"""Incremental forms of the detectors, as Structured Streaming queries."""
