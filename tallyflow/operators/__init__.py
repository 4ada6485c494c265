"""Operators over ledger, rate and event frames; each returns a DataFrame."""
