"""Property-graph analytics on Spark: path, relational and logic queries as DataFrame plans."""
