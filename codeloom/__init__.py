"""A Spark-native engine for analysing coded text and preparing large text corpora."""
