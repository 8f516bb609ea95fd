"""Job-market analytics written as Spark DataFrame jobs."""
