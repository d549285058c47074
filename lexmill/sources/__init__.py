"""Sources of lexmill."""
