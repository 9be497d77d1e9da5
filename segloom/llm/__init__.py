"""Operators for training data made from timed segments and documents."""
