"""plumbline: a PySpark-native engine for manufacturing-quality data.

Everything is a function from DataFrames to a DataFrame; nothing runs until the caller acts on the result.
"""
