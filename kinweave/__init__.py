"""Identity-resolution, PII and tagging analytics as plain Spark DataFrame jobs."""
