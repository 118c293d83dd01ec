"""weftgraph: a Spark-native engine for weighted graphs and their training data."""
