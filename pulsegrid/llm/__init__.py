"""Operators that prepare text for training. Nothing outside this folder imports them."""
