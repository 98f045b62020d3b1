"""Automata, relational planning and the logic compiler."""
