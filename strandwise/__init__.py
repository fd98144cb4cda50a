"""Sequence analytics on Spark: long reads, k-min-mers, overlaps and assembly graphs as DataFrames."""
