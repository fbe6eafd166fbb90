"""Equipment-reliability analytics as Spark jobs."""
