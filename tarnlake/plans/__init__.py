"""Pipelines: landing, incremental merge, marts, replay, and the registry that orders them."""
