"""Training-data operators on Spark: the dealt operators, their queries and their SQL."""
