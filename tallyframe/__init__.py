"""Inventory analytics expressed on the DataFrame, SQL and Structured Streaming APIs."""
