"""Segment analytics on Spark: cut ordered score timelines into segments and remove near-duplicate segments."""
