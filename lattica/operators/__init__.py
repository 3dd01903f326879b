"""Operators over graphs: mapping, paths, rules, validation, analytics, updates."""
