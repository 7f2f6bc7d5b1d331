"""Placeholders in streams."""
