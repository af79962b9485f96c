"""Franchise-operator analytics on Spark DataFrames."""
