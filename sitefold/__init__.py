"""Export and analysis of captured content-management responses on Spark.

Every table carries a ``site`` column, so one job covers any number of sites.
"""
