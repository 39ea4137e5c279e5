"""Readers, writers and table schemas."""
