"""Readers, writers and the sealed dataset format."""
