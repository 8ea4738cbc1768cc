"""findloom: catalog indexing and literal search on PySpark."""
