"""Operators for building training corpora: one module each, and `queries` that binds them to tables."""
