"""Procurement analytics as Spark DataFrame jobs.

Every operator is a function from DataFrames and plain parameters to a
DataFrame.  Column names are parameters whose defaults are the canonical names
of :mod:`lotwatch.schema`.
"""

from lotwatch.session import build_session

__all__ = ["build_session"]
