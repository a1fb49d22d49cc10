"""inkwell: a Spark-native engine for scientific-literature corpora."""
