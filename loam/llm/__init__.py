"""Corpus preparation operators for training data (imported by nothing else in loam)."""
