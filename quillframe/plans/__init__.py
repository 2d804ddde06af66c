"""Whole jobs on corpora of packages, and the queries of this library."""
