"""Operators on tables of timed segments, keyed by media_id."""
