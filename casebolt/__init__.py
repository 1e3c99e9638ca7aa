"""casebolt: a Spark-native engine for document review, search and text-collection processing."""
