"""Column functions: spans, checksums, text quality."""
