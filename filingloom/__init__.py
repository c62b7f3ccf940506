"""Topic, peer and risk-drift analytics over company filings, on Spark DataFrames."""
