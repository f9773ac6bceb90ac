"""Whole-query plans over the engine's operators."""
