"""Spark jobs that build and query a document retrieval index."""
