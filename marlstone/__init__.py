"""A Spark-first engine for retrieval analytics over document corpora."""
