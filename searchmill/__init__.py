"""Documentation search, crawl state and search analytics as PySpark plans."""
