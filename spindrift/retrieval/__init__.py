"""Batch text and vector retrieval over policy documents."""
