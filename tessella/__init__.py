"""Cluster analysis of large case-by-variable tables on Spark."""
