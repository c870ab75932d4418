"""Registered plans over the stored tables."""
