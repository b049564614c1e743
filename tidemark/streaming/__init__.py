"""Structured Streaming versions of the tick, bar and indicator jobs."""
