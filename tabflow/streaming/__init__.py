"""Structured Streaming: scoring a stream with a fitted model."""

from tabflow.streaming.score_stream import score_stream  # noqa: F401
