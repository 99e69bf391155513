"""Table schemas, readers, derived directory tables and the snapshot sink."""
