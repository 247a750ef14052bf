"""Batch grading and analysis of machine-written SQL, and corpus preparation, on Spark."""
