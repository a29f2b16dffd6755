"""strandframe: interval and copy-number analytics as plain Spark DataFrames."""
