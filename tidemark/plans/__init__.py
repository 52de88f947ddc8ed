"""The catalogue of queries over the shared tables."""
