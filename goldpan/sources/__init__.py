"""Readers and writers: every one takes or returns DataFrames."""
