"""Operators on reads, pileup columns, regions, candidates, features and records."""
