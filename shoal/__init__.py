"""Looking after machine-learning datasets with Spark DataFrames."""
