"""A Spark-native relational engine: a strict SQL dialect over typed, versioned tables."""
