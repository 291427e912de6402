"""Bag-of-visual-words analytics on Spark."""
