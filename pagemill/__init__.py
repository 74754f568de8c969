"""pagemill: content extraction, chunking and event routing as Spark jobs."""
