"""Retrieval, record repair and text analytics as PySpark DataFrame jobs."""
