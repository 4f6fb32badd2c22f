"""The queries, by subject; each module has QUERIES and ORACLES."""
