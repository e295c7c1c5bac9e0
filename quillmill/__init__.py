"""quillmill: a Spark-native engine for labelled-text corpora."""
