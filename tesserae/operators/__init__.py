"""Operators over whole matrix sets: means, pairs, models, tests, transfer."""
