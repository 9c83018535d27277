"""Reading source trees, selecting files, and the Parquet index on disk."""
