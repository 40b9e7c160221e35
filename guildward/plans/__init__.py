"""Whole queries: the decision pipeline and the console."""
