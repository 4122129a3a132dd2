"""Readers, writers and table contracts."""
