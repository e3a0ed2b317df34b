"""Whole data flows put together from sources, functions and operators."""
