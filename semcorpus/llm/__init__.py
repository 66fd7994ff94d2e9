"""Operators for preparing text to train language models."""
