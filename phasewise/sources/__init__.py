"""Readers of genomic files."""
