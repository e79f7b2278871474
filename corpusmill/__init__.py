"""Text corpus curation on Spark DataFrames."""
