"""inkgraph: a Spark-native engine for curating and scoring structured-diagram training data."""
