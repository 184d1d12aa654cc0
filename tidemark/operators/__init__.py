"""Operators over DataFrames that Spark has no single function for."""
