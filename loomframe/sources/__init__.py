"""Reading and writing: CSV, JSON, Parquet, and frames from Python values."""
