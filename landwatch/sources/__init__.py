"""Reading landed metadata, state tables, logs and sync events."""
