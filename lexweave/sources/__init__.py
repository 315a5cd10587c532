"""Readers and writers: term dictionaries, documents, word lists, result tables."""
