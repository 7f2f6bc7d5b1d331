"""Operators on spans, placeholders and the vault."""
