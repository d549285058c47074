"""Preparation of training data: ranking, term statistics, packing, mixing and subjects."""
