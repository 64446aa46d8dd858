"""Spark-native analytics over text corpora; every operator is a DataFrame or Column expression."""
