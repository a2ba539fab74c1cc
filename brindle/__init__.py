"""Evidence retrieval, table analysis and corpus preparation as plain PySpark plans."""
