"""tessera: spatial co-progression analytics on Spark DataFrames."""

__version__ = "0.1.0"
