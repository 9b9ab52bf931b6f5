"""Structured Streaming: slots, hours, sessions, and the latest state of each facility."""
