"""Operators over language: they import the core, never the other way round."""
