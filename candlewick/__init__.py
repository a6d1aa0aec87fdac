"""candlewick: OHLCV time-series analytics on Spark DataFrames.

The plans are declared with DataFrame and SQL expressions only; see README.md for the map of modules.
"""

__version__ = "0.1.0"
