"""Log tables: day scan, schema, keys, catalogue."""
