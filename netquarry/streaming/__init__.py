"""Structured Streaming operators."""

from netquarry.streaming.rollup import stream_rollup

__all__ = ["stream_rollup"]
