"""Operators for training data: cutoffs, token budgets, sketches, overlap, sampling, packing, mixing, reading level."""
