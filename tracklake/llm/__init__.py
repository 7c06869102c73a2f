"""Operators that prepare text and catalog data for training; nothing else in the library imports this."""
