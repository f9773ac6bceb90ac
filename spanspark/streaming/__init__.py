"""Structured Streaming forms of the engine's append log."""
