"""Training-data operators: thirteen corpus operators on Spark DataFrames.

Nothing outside this package imports it.  Each module holds one operator with
a general interface; :mod:`panelcast.llm.queries` registers the thin queries.
"""
