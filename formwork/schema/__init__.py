"""The schema language: written as text or built in Python, compiled to canonical types."""
