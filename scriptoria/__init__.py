"""scriptoria: a Spark-native engine for grounding, condensing and checking document collections."""
