"""Operators of lexmill."""
