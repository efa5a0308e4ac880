"""Readers of delimited tables and of reference tables."""
