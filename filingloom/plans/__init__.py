"""The whole analysis in order, and the registered queries with their SQL checks."""
