"""Structured Streaming: windowed aggregates with watermarks, and running a stream to its end."""
