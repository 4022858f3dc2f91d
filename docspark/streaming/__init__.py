"""Incremental ingestion of a folder, an extension of the batch readers."""
