"""Stages, pipelines and the flows built from them."""
