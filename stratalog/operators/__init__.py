"""Operators over versions, commands and traces."""
