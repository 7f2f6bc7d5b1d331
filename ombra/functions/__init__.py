"""Lexicons, validators and text functions."""
