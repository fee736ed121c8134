"""Operators on tensors, each a plan over plans."""
