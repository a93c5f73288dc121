"""Analytics for timed readings per station, as Spark DataFrame jobs."""
