"""Keyed, ordered state: batch and Structured Streaming forms."""
