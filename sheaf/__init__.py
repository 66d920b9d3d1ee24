"""Document ingestion and hybrid retrieval as PySpark DataFrame operators."""
