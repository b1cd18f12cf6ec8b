"""A DataFrame engine for sets of DNA k-mers."""
