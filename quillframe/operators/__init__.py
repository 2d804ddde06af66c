"""Operators: DataFrame in, DataFrame out, each row keyed by doc_id and an explicit order column."""
