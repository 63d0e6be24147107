"""Compositions of operators: fixtures, maintenance runs, size-checked broadcast."""
