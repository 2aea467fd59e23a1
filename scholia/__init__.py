"""Scholarly-metadata analytics on Spark."""
