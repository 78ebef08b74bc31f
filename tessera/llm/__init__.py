"""Operators that turn a raw text corpus into training data."""
