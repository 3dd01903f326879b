"""Expressions and functions over typed columns and terms."""
