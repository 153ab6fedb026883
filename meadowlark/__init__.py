"""meadowlark: semi-structured annual report analytics as Spark jobs."""
