"""parallax: a Spark-native engine for finding disagreements between sources.

Everything is a function from DataFrames to DataFrames; see README.md for the layout.
"""
