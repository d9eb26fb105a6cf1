"""PySpark engine for aggregate nearest-neighbour analytics on road networks."""
