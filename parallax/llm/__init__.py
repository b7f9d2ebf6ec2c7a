"""Operators for training text and model output. Nothing outside this subpackage imports it."""
