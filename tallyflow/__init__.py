"""Ledger-flow analytics on Spark DataFrames and Structured Streaming."""
