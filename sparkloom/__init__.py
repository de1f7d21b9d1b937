"""Session and corpus analytics on Spark: operators, sources, functions, plans, streams."""
