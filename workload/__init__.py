"""The operators applied to the given test tables, and the same queries in SQL."""
