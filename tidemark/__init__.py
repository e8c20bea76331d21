"""Feature data on Spark: batch features, point-in-time training sets, latest tables, monitoring."""
