"""Corpus operators for training data: one module each, all plain functions from DataFrames to DataFrames."""
