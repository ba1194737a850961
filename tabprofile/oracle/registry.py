"""Queries over the driver's tables, grouped by what they exercise."""

from . import cleaning, diagnostics, profiles, relations

QUERIES = profiles.QUERIES | cleaning.QUERIES | diagnostics.QUERIES | relations.QUERIES
ORACLE = profiles.ORACLE | cleaning.ORACLE | diagnostics.ORACLE | relations.ORACLE
