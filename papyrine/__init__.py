"""Papyrine."""
