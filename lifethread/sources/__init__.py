"""Readers and writers for the record files."""
