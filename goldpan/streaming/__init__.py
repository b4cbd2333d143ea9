"""Append-only log streams."""
