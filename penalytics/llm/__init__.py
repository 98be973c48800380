"""Operators of a training-data pipeline, each a set of Spark jobs over whole tables."""
