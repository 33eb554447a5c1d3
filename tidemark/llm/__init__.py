"""Operators for building training data from text and vectors at scale."""
