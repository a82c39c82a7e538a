"""A PySpark engine that finds, removes and re-checks personal identifiers."""
