"""Structured Streaming forms of the counters, the TTL cache and the sink."""
