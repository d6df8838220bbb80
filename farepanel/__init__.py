"""Spark operators for repeated price observations of the same items over time."""
