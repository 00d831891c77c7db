"""A PySpark engine that turns scientific documents into a queryable knowledge graph."""
