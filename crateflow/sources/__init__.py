"""Sources: driver tables, logical bindings, landed payloads, table management."""
