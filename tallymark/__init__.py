"""tallymark: agent-usage analytics and corpus preparation, expressed as Spark jobs."""
