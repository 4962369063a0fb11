"""Readers and writers of the movement tables."""
