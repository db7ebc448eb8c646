"""Operators that keep state between runs: rollups and policies; and joins by range."""
