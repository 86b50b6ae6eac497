"""Versioned text evidence, bounded retrieval and corpus tools on Spark DataFrames."""
