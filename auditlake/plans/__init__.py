"""Whole-query compositions."""
