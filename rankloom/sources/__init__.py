"""Readers, writers and dataset shaping."""
