"""Input tables, fixed parameter tables, data generation and table writers."""
