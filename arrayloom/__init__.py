"""arrayloom: array-region, detector-event and batch analytics as Spark DataFrames."""

__version__ = "0.1.0"
