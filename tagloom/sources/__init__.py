"""Readers, writers and generators of record files."""
