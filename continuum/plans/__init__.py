"""Whole-study plans made from the operators."""
