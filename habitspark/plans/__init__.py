"""Reusable physical strategies: size-checked joins, split prefix sums, spatial joins."""
