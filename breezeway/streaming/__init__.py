"""The ingest gate and the jobs that run on streams."""
