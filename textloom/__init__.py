"""textloom: Spark-native operators for language-model training data."""
