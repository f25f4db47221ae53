"""Plans of the feedback engine."""
