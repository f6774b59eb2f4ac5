"""Facts, concepts and rules on Spark: a declarative analytics engine."""
