"""Whole workflows: fitting, separable factorisation, comparison of methods."""
