"""Readers that give the event relation."""
