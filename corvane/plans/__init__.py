"""Corvane plans."""
