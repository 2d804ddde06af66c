"""Incremental ingestion of packages."""
