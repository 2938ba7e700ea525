"""Search-keyword research on Spark."""
