"""marque: a Spark-native engine for wide, multi-source product catalogs."""
