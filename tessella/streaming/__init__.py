"""The change feed of the snapshot log, read by Structured Streaming."""
