"""siftline: a Spark-native engine for document retrieval and corpus analytics."""
