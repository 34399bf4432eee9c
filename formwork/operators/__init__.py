"""Validation as column expressions, and what is built on it."""
