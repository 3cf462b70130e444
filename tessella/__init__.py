"""Tessella: a knowledge-base analytics engine on Spark DataFrames."""
