"""Scans: CSV files, JSON payloads, Parquet/Avro tables and backups, JDBC."""
