"""Operators that prepare text for training language models; nothing else in the library imports them."""
