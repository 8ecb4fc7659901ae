"""layoutq: fuzzy queries over laid-out documents, on Spark DataFrames."""

__version__ = "0.1.0"
