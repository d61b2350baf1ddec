"""Cloud cost-and-usage analytics as Spark jobs."""
