"""DataFrame operators on road networks."""
