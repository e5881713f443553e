"""Allele-specific analytics and training-data operators as Spark plans."""
