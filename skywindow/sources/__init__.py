"""Readers of spot archives, space weather and solar indices."""
