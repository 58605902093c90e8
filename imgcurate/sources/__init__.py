"""Readers and catalog operations."""
