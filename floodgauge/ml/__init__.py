"""Scaling, feature selection, models and their storage."""
