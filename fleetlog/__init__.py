"""fleetlog: log analytics for a fleet of service nodes, written as Spark jobs.

Multi-line text logs are framed and parsed into a typed, node-partitioned
table; questions over it are DataFrame operators: time range and predicate
selection, distinct-value catalogs, full-text search, symbol recovery and
call-stack reconstruction.
"""

__version__ = "0.1.0"
