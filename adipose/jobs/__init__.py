"""Registered queries over the star-schema tables and the three workloads."""
