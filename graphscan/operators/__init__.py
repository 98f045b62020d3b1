"""Predicates, walks and write-side operators."""
