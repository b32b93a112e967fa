"""Operators over the text of a training corpus."""
