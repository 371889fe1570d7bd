"""Distributed plans that no single built-in gives: dense global order, prefix scans, partial products."""
