"""Pipelines that chain several operators over a ping table."""
