"""Reusable relational operators composed from DataFrame primitives."""
