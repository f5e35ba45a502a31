"""Batch-trajectory analytics written as PySpark DataFrame jobs."""
