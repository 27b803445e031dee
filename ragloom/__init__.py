"""Batch and streaming jobs for document retrieval at corpus scale, on Spark DataFrames."""
