"""Readers and writers for logger exports and qualified tables."""
