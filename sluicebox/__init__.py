"""Sluicebox: a record engine for PySpark.

Parameterised reads, change sets, merges, record formats, a query cache, a
dictionary service and validation, all as DataFrame programs.
"""

__version__ = "0.1.0"
