"""Readers, writers and panels derived from raw tables."""
