"""Whole plans, from a score table to segments."""
