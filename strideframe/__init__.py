"""Sequence cleaning, occlusion analytics and classifier evaluation on Spark."""
