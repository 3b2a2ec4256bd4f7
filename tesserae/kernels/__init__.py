"""Batched numpy kernels on symmetric and Hermitian positive definite matrices; no Spark in here.

All functions take stacks of shape (..., p, p) and broadcast over the leading axes.
"""
