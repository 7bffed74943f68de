"""Pipelines, the serving layer, and the registered queries."""
