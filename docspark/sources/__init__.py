"""Readers: pure functions from bytes to rows, and the Spark stage that applies them to a folder of files."""
