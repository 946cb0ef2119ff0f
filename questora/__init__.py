"""A Spark-native engine for curated question-and-answer content."""
