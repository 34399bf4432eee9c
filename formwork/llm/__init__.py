"""Operators for preparing training text at scale: search, quality, licences, toxicity,
mixing, de-duplication, tokenising and personal data.

Every operator takes and returns DataFrames.  ``queries`` registers one query for each.
Nothing outside this subpackage imports it.
"""
