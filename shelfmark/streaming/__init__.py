"""Flows over file streams."""
