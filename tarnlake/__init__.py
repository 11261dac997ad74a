"""Tarnlake: a Spark-first clickstream lakehouse and analytics engine."""
