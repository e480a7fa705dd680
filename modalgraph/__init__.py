"""A Spark-native engine for labelled graphs of web pages and for preparing text corpora."""
