"""Spark-native analytics for single-object microscopy tables.

Masks are run-length tables, transcripts are points, measurements are long feature
tables; every operator takes DataFrames plus column names and returns a lazy DataFrame.
"""

__version__ = "0.1.0"
