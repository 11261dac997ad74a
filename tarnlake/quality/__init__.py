"""Declarative checks, contracts, reconciliation and run metrics."""
