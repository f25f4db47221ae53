"""Sources of the feedback engine."""
