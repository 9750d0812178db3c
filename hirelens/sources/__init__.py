"""Reading raw CSV postings, storing and reading the cleaned Parquet table."""
