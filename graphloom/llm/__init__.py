"""Operators that prepare text and records for training data. Nothing outside this subpackage imports it."""
