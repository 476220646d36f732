"""Readers and writers: JSON lines, vector files, seed lists, embedders, page fetching, state, query log and rank tables."""
