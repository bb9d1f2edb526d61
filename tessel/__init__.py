"""tessel: vector search and corpus analytics on PySpark."""
