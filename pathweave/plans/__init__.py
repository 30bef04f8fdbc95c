"""Whole jobs put together from operators: building layouts, comparing them."""
