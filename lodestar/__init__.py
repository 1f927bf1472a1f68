"""lodestar: a Spark-native evidence-retrieval and research-analytics engine."""
