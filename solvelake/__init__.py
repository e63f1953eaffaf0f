"""Set-at-a-time analytics for timed, team-based competitions on Spark."""
