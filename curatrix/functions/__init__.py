"""Row-local Column expressions."""
