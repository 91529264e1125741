"""Full-text search, retrieval evaluation and corpus analytics as Spark DataFrame pipelines."""
