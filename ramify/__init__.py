"""Divide-and-conquer analytics on Spark."""
