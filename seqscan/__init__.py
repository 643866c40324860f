"""Exact protein sequence search on Spark."""
