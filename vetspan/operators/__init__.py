"""State tables, reports and policies over DataFrames; clocks are always parameters."""
