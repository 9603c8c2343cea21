"""Texture analytics on Spark."""
