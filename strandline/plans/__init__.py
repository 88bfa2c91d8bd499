"""Jobs and the catalogue of queries."""
