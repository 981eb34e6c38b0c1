"""Structured Streaming driver of the change feed."""

from .feed import run_feed, apply_batch, FeedTables

__all__ = ["run_feed", "apply_batch", "FeedTables"]
