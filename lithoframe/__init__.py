"""Content-addressed state on Spark: blocks, chained prefix keys, an ordered mutation log, leases, segment files."""
