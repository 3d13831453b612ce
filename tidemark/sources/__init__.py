"""Readers, writers, the dataset catalogue and retention."""
