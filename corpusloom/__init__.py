"""Corpus preparation, instruction data and text evaluation as Spark jobs."""
