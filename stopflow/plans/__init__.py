"""The incremental batch and the publication of the serving tables."""
