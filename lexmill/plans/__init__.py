"""Plans of lexmill."""
