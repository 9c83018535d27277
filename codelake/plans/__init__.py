"""Whole jobs composed from the operators: indexing, search, registered queries."""
