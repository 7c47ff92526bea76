"""gleanery: hybrid document retrieval, incremental indexing and corpus preparation on PySpark."""
