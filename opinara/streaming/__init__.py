"""Streaming of the feedback engine."""
