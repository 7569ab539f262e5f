"""Spark-native analytics over ontologies, knowledge graphs and the texts they are built from."""
