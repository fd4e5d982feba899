"""Structured Streaming: ingestion of change events and live pipeline signals."""
