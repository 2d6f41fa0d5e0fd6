"""Choices of plan shape."""
