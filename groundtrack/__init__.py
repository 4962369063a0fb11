"""Spark jobs for multi-camera movement tables and for training-text corpora."""
