"""gossamer: a Spark-native engine for analysing web-site crawls."""
