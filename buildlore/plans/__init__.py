"""Whole jobs composed from the operators, and views over the test tables."""
