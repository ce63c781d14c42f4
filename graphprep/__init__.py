"""Graph-example preparation and evaluation on Spark DataFrames."""
