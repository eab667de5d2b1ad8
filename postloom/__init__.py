"""Spark-first analytics for streams of short texts."""
