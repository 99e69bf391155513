"""Structured Streaming jobs and the session-state rules they share with batch."""
