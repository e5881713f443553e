"""Whole queries, their registry and the command line."""
