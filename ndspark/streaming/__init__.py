"""Reductions over streams."""
