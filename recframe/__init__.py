"""recframe: analytics on click logs and recommendation data, written for Spark's DataFrame and SQL engine."""
