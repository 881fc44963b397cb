"""Text relevance ranking on Spark: cleaning, label tables, per-user models, incremental refresh."""
