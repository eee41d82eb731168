"""Readers and writers of bundles."""
