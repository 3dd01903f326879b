"""Readers and writers of graph and result formats."""
