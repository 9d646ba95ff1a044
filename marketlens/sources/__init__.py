"""Schemas, raw-text ingest, the test-table adapter and the table catalog."""
