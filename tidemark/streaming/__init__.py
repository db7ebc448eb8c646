"""Rollups of streams."""
