"""cliploom: Spark-native analytics over media-clip metadata, transcripts and text corpora."""
