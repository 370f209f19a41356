"""Quality checks for synthetic JSON tables, written as Spark DataFrame jobs.

Nested records become a tall table of typed cells; every metric is an
aggregation, join or window over that table.
"""
