"""Stateless pipelines over a growing folder of documents, with Structured Streaming."""

from papyra.streaming.flow import STATELESS, stream, stream_into

__all__ = ["STATELESS", "stream", "stream_into"]
