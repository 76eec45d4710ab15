"""Spark jobs that prepare large document collections for translation."""
