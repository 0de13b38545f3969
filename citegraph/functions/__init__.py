"""Catalyst column expressions and small Arrow functions."""
