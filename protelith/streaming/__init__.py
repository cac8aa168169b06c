"""Continuous metrics."""
