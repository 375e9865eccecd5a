"""A Spark-native SQL analytics engine: dialect, catalog, DML and transactions over Spark SQL."""
