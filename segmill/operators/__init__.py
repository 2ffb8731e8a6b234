"""Operators over timelines: boundaries, intervals, deduplication, decoding, frames, queues."""
