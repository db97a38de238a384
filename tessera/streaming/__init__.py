"""Mutable banks and the append/remove log."""
