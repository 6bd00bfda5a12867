"""Gridloom: gridded-field analytics expressed as Spark DataFrames."""
