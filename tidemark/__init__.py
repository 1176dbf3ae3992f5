"""tidemark: market-data, strategy and corpus analytics as Spark jobs."""
