"""Streaming: incremental scoring of new questions."""
