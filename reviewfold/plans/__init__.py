"""Whole studies composed from the operators, and the registered queries."""
