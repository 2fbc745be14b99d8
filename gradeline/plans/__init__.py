"""Composed runs built from the operators."""
