"""Whole plans: labels, features, evaluation, acceptance, prediction surface."""
