"""Operators: profile, trends, treatment, moments, reduction, scoring."""
