"""Operators on text corpora for training and retrieval data."""
