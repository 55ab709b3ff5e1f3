"""vacancia: ingest, clean, de-duplicate and triage document-like records with PySpark."""
