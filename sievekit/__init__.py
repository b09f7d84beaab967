"""sievekit: payload analytics and classification on Spark DataFrames."""

__version__ = "0.1.0"
