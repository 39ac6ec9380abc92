"""Jobs that move a corpus from files to published tables."""
