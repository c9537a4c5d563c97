"""docloom: Spark-native analytics over document corpora and the records drawn from them."""
