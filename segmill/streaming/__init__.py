"""Streaming forms of ordered operators."""
