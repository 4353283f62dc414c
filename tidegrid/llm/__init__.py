"""Operators for building text training data. Nothing else in the library imports this subpackage."""
