"""siftmill: a Spark-native engine that screens bodies of papers for selective reporting."""
