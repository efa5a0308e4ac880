"""Spark jobs for quantitative lipidomics tables and for training-text corpora."""
