"""Structured Streaming forms of the usage counters and of adjudication."""
