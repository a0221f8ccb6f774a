"""Entity-embedding curation and analytics on PySpark."""
