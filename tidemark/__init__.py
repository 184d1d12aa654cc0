"""Spark-native market research analytics."""
