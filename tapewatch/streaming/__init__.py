"""Streaming of the tick analytics library."""
