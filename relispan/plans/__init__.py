"""Composed plans: workflows, shared tables, registered queries."""
