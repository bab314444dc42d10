"""Operators that prepare text and source code for training. Nothing else in the library imports this."""
