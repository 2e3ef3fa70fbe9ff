"""Tessera: retrieval, turn-log and training-data operators expressed as Spark DataFrames."""
