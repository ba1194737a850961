"""Operators for training-data pipelines, each a Spark job over whole tables.

Nothing outside this subpackage imports it; the queries that apply the
operators to the driver's tables are in :mod:`tabprofile.llm.queries`.
"""
