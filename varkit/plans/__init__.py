"""Registered queries over the example tables, their SQL oracles and plan checks."""
