"""Readers and reference-shaped views over the driver tables."""
