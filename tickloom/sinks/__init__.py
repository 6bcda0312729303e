"""Exports. What grows with a profile is written by Spark; what a person reads is bounded and rendered on the driver."""
