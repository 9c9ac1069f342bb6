"""Sources: the driver's parquet tables mapped to domain tables, raw feed
normalisation, and decoding of string-matrix query results."""
