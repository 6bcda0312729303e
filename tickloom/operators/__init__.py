"""Relations computed from a profile's views."""
