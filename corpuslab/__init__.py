"""corpuslab: corpus preparation, linking, retrieval and evaluation as Spark jobs."""
