"""strandloom: Spark-native operators for retrieval, event logs and data preparation."""
