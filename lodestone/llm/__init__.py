"""Operators for building text and code training data. Nothing else in the library imports this subpackage."""
