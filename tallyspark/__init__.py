"""Receipt-to-ledger analytics as DataFrame jobs and Structured Streaming jobs."""
