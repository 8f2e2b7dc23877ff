"""Writes: the bucketed table store (append, upsert, wipe) and file writers."""
