"""corpusloom: a Spark-native engine for document corpora and hybrid retrieval."""
