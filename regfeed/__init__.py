"""Event feeds of a public company register, on Spark."""
