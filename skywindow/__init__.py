"""Skywindow: HF band-openness analytics expressed as Spark DataFrame plans."""
