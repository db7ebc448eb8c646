"""Embedding, vector search and prompts, with offline stand-ins for remote models."""
