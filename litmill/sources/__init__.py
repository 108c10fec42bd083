"""Readers and writers of bibliographic formats."""
