"""Artifact-catalog analytics on Spark."""
