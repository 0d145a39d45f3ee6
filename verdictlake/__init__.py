"""verdictlake: preference analytics and corpus preparation as Spark jobs."""
