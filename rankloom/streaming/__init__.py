"""Streams of documents and of pairs."""
