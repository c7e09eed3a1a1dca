"""tidemark: profiling, repairing, scoring and auditing of tables as Spark DataFrames."""

__version__ = "0.1.0"
