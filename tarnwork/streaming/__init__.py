"""Structured Streaming queries. None yet: no streaming query is in the confirmed scope."""
