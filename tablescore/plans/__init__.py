"""Reports: leaderboards, speed, stability, distributions."""
