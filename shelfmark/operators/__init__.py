"""Joins, de-duplication, merges, counters and review queries."""
