"""Spark-native analytics for assessing datasets, models, logs and training corpora."""
