"""Whole joins composed from the operators."""
