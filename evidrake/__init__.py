"""A Spark-native engine for evidence retrieval and grounded answers over text tables."""
