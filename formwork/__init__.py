"""Schemas written in the shape of the data, compiled to Spark column expressions."""
