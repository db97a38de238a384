"""Queries and analytics over banks."""
