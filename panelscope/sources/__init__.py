"""Readers, writers and model persistence."""
