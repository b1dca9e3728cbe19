"""Column expressions: time text, buckets, attribute equality, text patterns, cursors, validation."""
