"""Code-index analytics and training-corpus preparation on Spark DataFrames."""

__version__ = "0.1.0"
