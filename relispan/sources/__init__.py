"""Readers and writers for the supported formats."""
