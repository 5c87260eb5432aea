"""Code-metadata graph analytics on PySpark."""
