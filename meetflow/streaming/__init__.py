"""Incremental re-analysis of functions that arrive or change in a stream."""
