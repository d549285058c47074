"""Functions of lexmill."""
