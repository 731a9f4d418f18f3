"""Relational and parsing operators."""
