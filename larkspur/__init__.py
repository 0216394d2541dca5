"""larkspur: document-collection analytics and data cleaning on Spark DataFrames."""
