"""Readers for the daily feed, and storage of intermediate tables."""
