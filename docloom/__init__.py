"""docloom: a Spark-native document-to-dataset engine."""
