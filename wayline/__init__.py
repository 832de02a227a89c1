"""Complex-event analytics on Spark: declarative patterns, predicates and identity as DataFrame plans."""
