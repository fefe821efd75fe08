"""Corpus preparation operators for training data, one module for each."""
