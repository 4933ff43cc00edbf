"""Keyed relations, secondary indexes and equi-joins on Spark DataFrames."""
