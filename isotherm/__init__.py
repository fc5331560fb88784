"""Gridded climate fields and station observations as Spark jobs."""
