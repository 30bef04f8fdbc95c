"""Readers and writers of every layout."""
