"""lectern: Spark-native analytics for reading libraries (ebooks, audiobooks, alignments, progress)."""
