"""Post search and post analytics on Spark DataFrames.

``operators``  relational operators (DataFrame -> DataFrame)
``sources``    readers, writers and table access
``functions``  column expressions and vectorised functions
``plans``      query language, planner and the search driver
``streaming``  Structured Streaming forms of the ingest operators
``queries``    the registered queries with their SQL twins
"""

__version__ = "0.1.0"
