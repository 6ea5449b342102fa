"""A Spark engine for tables that a specification describes."""
