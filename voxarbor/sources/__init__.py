"""Readers and writers of volume, tree and marker files."""
