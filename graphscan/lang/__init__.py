"""Texts of the three query languages to trees, and back."""
