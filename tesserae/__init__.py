"""Evidence, claims, search and duplicates of tagged media collections, as Spark jobs."""
