"""Operators over DataFrames: encoding, validation, statistics, matching, order and synthetic data."""
