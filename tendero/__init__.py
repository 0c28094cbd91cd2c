"""Retail analytics on Spark: sales, profiling, retrieval, log jobs, reports."""
