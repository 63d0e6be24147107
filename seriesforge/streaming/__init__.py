"""H1–H6: file-change events and request logs as Structured Streaming jobs."""
