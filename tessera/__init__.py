"""Tessera: corpus and language-model compression analytics on Spark DataFrames."""
