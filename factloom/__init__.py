"""factloom: a Spark-native engine for code-fact graphs, their text and their history."""
