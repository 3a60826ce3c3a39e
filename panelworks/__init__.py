"""Cross-sectional panel analytics on PySpark DataFrames."""
