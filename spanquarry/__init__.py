"""Spark-native analytics over traces of agent applications.

Every operator is a function from DataFrames to a DataFrame.  Nothing here opens a
session, collects rows, or reads the clock: time enters as an ``as_of`` argument and
the organization scope as an optional ``org`` argument (``None`` means every
organization at once, grouped by it).
"""
