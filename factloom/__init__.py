"""factloom: set-oriented analytics for keyed fact stores and program graphs on Spark DataFrames."""
