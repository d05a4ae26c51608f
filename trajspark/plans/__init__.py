"""Named queries over the given tables and the three whole workloads."""
