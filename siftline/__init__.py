"""siftline: document ingestion, retrieval and corpus preparation on PySpark."""
