"""The incremental index of masked documents."""
