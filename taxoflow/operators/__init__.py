"""Taxoflow operators."""
