"""Lexical-sophistication analytics on Spark DataFrames."""
