"""Operators of the feedback engine."""
