"""Registered queries: fixture views, Spark plans and their SQL oracles."""
