"""Subpackage of corpusgraph."""
