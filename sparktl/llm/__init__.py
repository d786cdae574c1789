"""Corpus operators for training-data pipelines.  Nothing else in sparktl imports this subpackage."""
