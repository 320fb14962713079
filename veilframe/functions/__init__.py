"""Column builders: they take and return ``Column`` and never run anything."""
