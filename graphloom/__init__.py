"""graphloom: set-wise graph-relational analytics on Spark DataFrames."""

__version__ = "0.1.0"
