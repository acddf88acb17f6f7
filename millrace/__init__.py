"""Build, score, filter, pair and audit text-generation datasets with Spark DataFrames."""
