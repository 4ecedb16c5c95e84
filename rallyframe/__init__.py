"""Spatio-temporal match analytics on Spark."""
