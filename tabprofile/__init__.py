"""Profiling, cross-filtering, cleaning and diagnosing of tables on Spark."""
