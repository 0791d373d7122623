"""Distributed Bayesian models, time series and posterior summaries on Spark DataFrames."""
