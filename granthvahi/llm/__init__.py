"""Operators that prepare text for training. Nothing outside imports this folder."""
