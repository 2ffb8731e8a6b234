"""Readers and writers of the tables that the operators work on."""
