"""Query catalogue: every registered query with its oracle SQL where SQL can express it."""
