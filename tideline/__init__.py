"""Spark-native analytics for behavioural event logs.

Every operator takes and returns DataFrames and stays lazy unless its docstring says that it runs a job.
"""

__version__ = "0.1.0"
