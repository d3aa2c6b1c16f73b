"""snipspark: a Spark-first engine for indexing, searching and selecting context."""
