"""Link-graph audit analytics, declared as Spark plans."""
