"""Structured Streaming: drains, triggers, retries, sessions; T1 to T6."""
