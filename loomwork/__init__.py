"""Document field extraction, merging, resolution and curation as Spark jobs."""
