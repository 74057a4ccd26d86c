"""Corvane functions."""
