"""quarrymill: a Spark-native engine for ranking, linking and auditing entities."""
