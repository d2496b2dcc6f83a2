"""Operators for training-data preparation: each module holds one of them."""
