"""Composite jobs (load, ingest, restore, backup) and the registered
queries bound to the driver's tables."""
