"""Match large tables of candidate documents against large tables of job postings, on Spark DataFrames."""
