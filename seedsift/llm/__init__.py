"""Operators for preparing large training-data corpora."""
