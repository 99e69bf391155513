"""rollcall: account-directory analytics on Spark.

``sources`` reads and derives the tables, ``functions`` holds column
expressions, ``operators`` the DataFrame -> DataFrame operators, ``plans``
the registered queries and their SQL oracle, ``streaming`` the Structured
Streaming jobs.  ``session`` has the shared settings and lineage cuts.
"""
