"""Scalar functions as column expressions: dice, scores, 32-bit hashes, statistics."""
