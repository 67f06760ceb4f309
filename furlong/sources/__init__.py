"""Sources and sinks: JSONL landing files, layered parquet tables."""
