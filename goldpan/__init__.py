"""Preparation, audit and scoring of query datasets as Spark jobs."""
