"""Assessment analytics on Spark: every operator maps DataFrames to DataFrames."""

__version__ = "0.1.0"
