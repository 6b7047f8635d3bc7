"""Operators of a training-data pipeline: tokens, cleaning, near copies, mixing, packing, classification."""
