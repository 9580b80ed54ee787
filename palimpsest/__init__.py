"""Finding, hiding and auditing personal data in large document collections with PySpark."""
