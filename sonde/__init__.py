"""Hybrid code search and training-data preparation on Spark."""
