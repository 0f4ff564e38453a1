"""Impact ratings, reliability measurement and data checks as Spark jobs."""
