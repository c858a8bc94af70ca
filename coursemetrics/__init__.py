"""coursemetrics — learning-activity analytics as Spark DataFrame jobs.

Layout
------
sources/    table readers, the driver-table binding, raw JSON readers, sinks
functions/  Column helpers (rounding, labels, text formatting, top-k)
operators/  silver, gold, named reports, features, dropout model,
            recommender, search, prompt/context tables
plans/      the registry of named queries and their DuckDB oracle SQL
streaming/  Structured Streaming versions of the silver/engagement jobs
"""

__version__ = "0.1.0"
