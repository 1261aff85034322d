"""factloom: set-based record-integrity and corpus operators on Spark DataFrames."""
