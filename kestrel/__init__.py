"""kestrel: a Spark-native tabular analytics toolkit.

Every operator takes and returns DataFrames; row-level data stays on the
executors and the driver only sees aggregates whose size does not grow with
the input.
"""

__version__ = "0.1.0"
