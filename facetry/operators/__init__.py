"""Distributed operators on feature tables."""
