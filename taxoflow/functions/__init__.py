"""Taxoflow functions."""
