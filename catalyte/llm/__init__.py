"""Training-data pipeline operators: ten stand-alone DataFrame-to-DataFrame
operators plus the queries that bind them to the synthetic tables.

Nothing outside this subpackage imports it.
"""
