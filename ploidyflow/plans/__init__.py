"""Whole plans: from reads to variant records."""
