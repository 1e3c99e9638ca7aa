"""Operators on free text and record linkage for large text collections. Nothing outside this package imports it."""
