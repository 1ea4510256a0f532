"""Content, search-quality and traffic analytics on PySpark."""
