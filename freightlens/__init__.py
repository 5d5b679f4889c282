"""Data quality of freight and invoices, causality and retrieval on Spark DataFrames."""
