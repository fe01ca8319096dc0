"""A keyed-record registry on Spark DataFrames."""
