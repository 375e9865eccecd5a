"""Sources and sinks: Parquet tables, CSV files, Arrow batches."""
