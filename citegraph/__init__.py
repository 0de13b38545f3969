"""Citation-corpus analytics on PySpark: ingestion, benchmark cuts, set scoring."""
