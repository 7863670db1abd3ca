"""Structured Streaming forms of the quality gate and the latency report."""
