"""Personalised semantic search, recommendation and corpus preparation on Spark DataFrames."""
