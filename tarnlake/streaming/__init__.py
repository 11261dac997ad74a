"""Structured Streaming front ends of the same operators."""
