"""Tablet analytics as Spark DataFrames: extraction, linkage, timelines, annotation."""
