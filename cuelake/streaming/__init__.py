"""Structured Streaming operators keyed by session_id."""
