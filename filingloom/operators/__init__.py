"""Operators from corpus to topics, peers and drift. Each maps DataFrames to DataFrames."""
