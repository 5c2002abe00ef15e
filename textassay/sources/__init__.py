"""Readers and writers: corpora and the results log."""
