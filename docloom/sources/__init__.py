"""Readers of documents, sessions and layouts."""
