"""sheaf: analytics over structured documents as Spark DataFrames."""

__version__ = "0.1.0"
