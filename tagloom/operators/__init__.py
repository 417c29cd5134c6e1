"""Distributed operators over records."""
