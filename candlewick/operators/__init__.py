"""Transformations over market tables."""
