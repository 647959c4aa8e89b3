"""Operators of a pipeline for language-model training data, each a module with its method."""
