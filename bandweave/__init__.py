"""Retrieval and mining over symbolic time series and vectors, as DataFrame operators on Spark."""
