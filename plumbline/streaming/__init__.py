"""Structured Streaming forms of the metric log and the loss guard."""
