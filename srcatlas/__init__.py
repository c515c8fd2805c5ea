"""Code-intelligence analytics on PySpark: source code as DataFrames."""
