"""Domain views over the benchmark tables and the registered queries with their SQL."""
