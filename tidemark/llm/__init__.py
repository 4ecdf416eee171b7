"""Operators for training data: names, groups, pieces, tokens, mixes and text quality."""
