"""Tables kept as Parquet change logs with snapshots."""
