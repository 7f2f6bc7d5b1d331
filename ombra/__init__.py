"""Reversible text pseudonymisation and document processing on Spark."""
