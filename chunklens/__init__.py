"""chunklens: deduplication analytics over chunk traces, on Spark."""
