"""Structured Streaming: partition discovery and event windows."""
