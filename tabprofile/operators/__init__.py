"""Spark jobs over tables: profiles, diagnostics, relations, row order."""
