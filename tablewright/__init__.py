"""tablewright: table cleaning, checking, profiling and reporting as lazy Spark DataFrames."""
