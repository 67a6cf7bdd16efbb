"""Structured Streaming jobs; the stateless ones reuse the batch functions unchanged."""
