"""Provenance-labelled property graphs as Spark DataFrames."""
