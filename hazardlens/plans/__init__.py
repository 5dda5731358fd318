"""Bundles that combine several operators."""
