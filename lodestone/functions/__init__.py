"""Lodestone functions."""
