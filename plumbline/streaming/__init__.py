"""Structured Streaming forms of ingestion and accumulation (an extension: the batch forms are the reference)."""
