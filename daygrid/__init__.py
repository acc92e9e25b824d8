"""Daily demand analytics expressed as Spark jobs."""
