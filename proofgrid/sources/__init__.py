"""Readers, writers and record shapes."""
