"""Spark-native analytics over set sketches and taxonomies."""
