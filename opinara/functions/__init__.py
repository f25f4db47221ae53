"""Functions of the feedback engine."""
