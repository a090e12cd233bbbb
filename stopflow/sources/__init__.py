"""Reading and writing tables, incremental ingest, and the projection of the test data."""
