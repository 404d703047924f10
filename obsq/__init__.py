"""obsq: Spark-native observation processing, quality control and diagnostics."""
