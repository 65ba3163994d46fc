"""Scalar column expressions and small numeric helpers."""
