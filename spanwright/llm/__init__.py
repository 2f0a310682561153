"""Operators for training data made of text. Nothing outside this folder imports it."""
