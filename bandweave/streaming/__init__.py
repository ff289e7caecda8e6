"""Symbolisation of unbounded series."""
