"""Training, evaluation, storage and batch scoring of MLlib models."""
