"""Sources and sinks: the caller's tables in, DataFrames out to any Spark writer."""
