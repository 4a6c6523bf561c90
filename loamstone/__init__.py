"""Loamstone: versioned-snapshot analytics built on PySpark DataFrames."""
