"""vetspan: message inspection, reputation state and reports as Spark DataFrames."""
