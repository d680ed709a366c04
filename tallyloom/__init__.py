"""tallyloom: conservation-preserving statistical-cube operators as lazy Spark DataFrames."""

__version__ = "0.1.0"
