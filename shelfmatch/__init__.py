"""shelfmatch: match query items against a product catalog with Spark DataFrames."""

__version__ = "0.1.0"
